"""Token counts, packing, sharding and the pipeline against plain versions."""

import collections
import zlib

import numpy as np
import public_tokenizers

from stocktake.llm import hypergeometric_shuffle, mixture_packing, token_cache

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_the_librarys_and_are_stored(spark, docs, texts, none):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = token_cache.TokenCountCache(spark, PIECES)
    assert cache.by_segment
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 50) for i, t in texts)
    for _ in range(2):  # the second time everything is stored
        got = cache.count(docs, limit=50)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    stored = spark.read.parquet(cache.path)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in texts})
    assert cache.count(none).count() == 0


def test_a_second_cache_finds_the_first_ones_counts(spark, docs, texts, none, monkeypatch):
    first = token_cache.TokenCountCache(spark, PIECES)
    first.count(docs).collect()
    before = spark.read.parquet(first.path).count()
    second = token_cache.TokenCountCache(spark, PIECES)
    assert second.path == first.path
    with monkeypatch.context() as m:  # nothing is missing, so nothing is encoded
        m.setattr(token_cache, "append_columns", None)
        assert second.count(docs).count() == len(texts)
    more = spark.createDataFrame([(1, "a text of its own"), (2, texts[0][1]), (3, "a text of its own")], "doc_id long, text string")
    assert second.count(more).count() == 3
    assert spark.read.parquet(first.path).count() == before + 1


def test_packing_is_a_partition_of_all_ids(docs, texts, none):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORDS)
    want = collections.Counter(tuple(tok.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in texts)
    rows = mixture_packing.pack(docs, WORDS, length=256, window_sequences=4).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        assert 0 < r.length <= 256 and r.start + r.length <= r.doc_tokens
    for at, (s, pieces) in enumerate(sorted(by.items())):
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert s == at and (end == 256 or at == len(by) - 1)
    ids = {i: t for i, t in texts if i not in (None, 105)}
    mine = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in ids.items()}
    pos = collections.Counter()
    for r in sorted((r for r in rows if r.doc_id in mine), key=lambda r: (r.doc_id, r.start)):
        assert r.start == pos[r.doc_id] and r.doc_tokens == len(mine[r.doc_id])
        part = np.array(mine[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
        pos[r.doc_id] += r.length
    assert all(pos[i] == len(x) for i, x in mine.items())
    assert sum(r.length for r in rows) == sum(len(k) * n for k, n in want.items())
    assert mixture_packing.pack(none, WORDS).count() == 0


def test_windows_hold_the_sources_shares(spark):
    rows = [(i, "word " * (5 + i % 20), "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    pieces = mixture_packing.pack(df, WORDS, length=64, window_sequences=16).collect()
    source = {i: s for i, _, s in rows}
    total, windows = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in pieces:
        total[source[r.doc_id]] += r.length
        windows[r.sequence_id // 16][source[r.doc_id]] += r.length
    whole = sum(total.values())
    upto = collections.Counter()
    for w in sorted(windows)[:-1]:
        upto.update(windows[w])
        for s in total:  # deficits are carried, so what is sent so far never strays by more than documents and a window's edge
            assert abs(upto[s] - total[s] / whole * 64 * 16 * (w + 1)) < 5 * 30


def test_word_encoder_on_hard_texts(texts):
    encoder = mixture_packing.WordEncoder(WORDS)
    assert encoder.exact and encoder.plain
    hard = ["İstanbul ΑΣ ς ﬁ ①②½ don't 'S 'LL x''s", "é é", "a b c​d", "\x00\x1f\x7f", "<|startoftext|>ok", "ÀÖØÞĀĭıŸſ×÷", "_a_1b2",
            "日本語テキスト", "🙂🙂 ok", "'s't're"]
    for t in hard + [t for _, t in texts if t]:
        assert encoder(t) == mixture_packing.encode_whole(t, encoder.tokenizer), t[:40]


def test_shards(docs, texts, none):
    rows = hypergeometric_shuffle.document_shards(docs, shards=7).collect()
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert len(rows) == len(texts) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t in texts)
    assert hypergeometric_shuffle.document_shards(none).count() == 0


def test_buckets_of_large_shards(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id").repartition(6)
    rows = hypergeometric_shuffle.uniform_shards(df, shards=3, rows_per_bucket=100).collect()
    for j in range(3):
        assert sorted(r.slot for r in rows if r.shard == j) == list(range(len([r for r in rows if r.shard == j])))
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sorted(order) == list(range(5000)) and abs(np.corrcoef(order, range(5000))[0, 1]) < 0.06


def test_matrix_has_exact_sums_and_hypergeometric_means():
    parts = [700, 0, 300, 5, 1200]
    draws = np.stack([hypergeometric_shuffle.communication_matrix(parts, 4, s) for s in range(400)])
    assert (draws.sum(axis=2) == parts).all()
    assert (np.ptp(draws.sum(axis=1), axis=1) <= 1).all() and (draws.sum(axis=(1, 2)) == sum(parts)).all()
    expected = np.array(parts) / 4
    spread = np.sqrt(np.array(parts) * 0.25 * 0.75 * (1 - np.array(parts) / sum(parts)) * sum(parts) / (sum(parts) - 1))
    assert (np.abs(draws[:, :, 0].mean(axis=0) - expected) <= 4 * np.maximum(spread, 1e-9) / 20 + 1e-9).all()
    assert (np.abs(draws[:, :, 0].std(axis=0) - spread) <= 0.2 * spread + 1e-9).all()
    assert hypergeometric_shuffle.communication_matrix([], 4, 1).shape == (0, 4)


def test_pipeline_stages(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash_neardup", "benchmark_decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        path = spark.conf.get("spark.checkpoint.dir") + f"/pipeline-{name}"
        out.write.mode("overwrite").parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert 0 < docs.count() <= before.count() and docs.join(before, columns, "left_anti").count() == 0
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == ids
