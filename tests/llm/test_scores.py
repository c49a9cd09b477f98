"""Language model, toxicity, quality, license and benchmark operators."""

import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from stocktake.llm import context_tree, latent_decontamination, license_scan, quality_knn, toxicity_fm
from llm.conftest import frame, prose


def held(i, m, r):
    return i is not None and zlib.crc32(str(i).encode()) % m == r


def test_base_score_and_counts(docs, texts, none):
    got = context_tree.scored(docs).collect()
    counts = collections.Counter()
    for i, t in texts:
        if not held(i, 10, 0):
            counts.update((t or "").encode().lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in texts:
        w = (t or "").encode().lower().split() + [None]
        want.append((str(i), held(i, 10, 0), len(w), sum(counts[x] > 0 for x in w), n,
                     round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert context_tree.scored(none).count() == 0


def test_context_tree_against_a_recursive_one(docs, texts, monkeypatch):
    streams = [b" ".join((t or "").encode().lower().split()) + b"\n" for _, t in texts]
    depth = context_tree.DEPTH
    seen = collections.defaultdict(lambda: [0, 0])  # (context, bits so far) -> zeros, ones
    children = collections.defaultdict(set)
    for (i, _), s in zip(texts, streams):
        if held(i, 10, 0):
            continue
        padded = b"\0" * depth + s
        for k, byte in enumerate(s):
            for j in range(8):
                bits = (1 << j) | byte >> (8 - j)
                for d in range(depth + 1):
                    seen[padded[k + depth - d:k + depth], bits][byte >> (7 - j) & 1] += 1
                    if d < depth:
                        children[padded[k + depth - d:k + depth], bits].add(padded[k + depth - d - 1:k + depth])

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted = {}
    for (c, bits), (a, b) in sorted(seen.items(), key=lambda x: -len(x[0][0])):
        weighted[c, bits] = kt(a, b) if len(c) == depth else float(np.log(.5) + np.logaddexp(
            kt(a, b), sum(weighted[x, bits] for x in children[c, bits])))

    def probability(context, bits, bit, d=0):
        node = (context[len(context) - d:], bits)
        if node not in seen:
            return None
        a, b = seen[node]
        estimate = ((b if bit else a) + .5) / (a + b + 1)
        deeper = probability(context, bits, bit, d + 1) if d < depth else None
        if deeper is None:
            return estimate
        stop = math.exp(math.log(.5) + kt(a, b) - weighted[node])
        return stop * estimate + (1 - stop) * deeper
    got = {(str(r.doc_id), r.n_tokens): r.score for r in context_tree.scored(docs).collect()}
    for (i, t), s in zip(texts, streams):
        if len(s) > 1500 or i == 105:
            continue
        padded, total = b"\0" * depth + s, 0.0
        for k, byte in enumerate(s):
            for j in range(8):
                p = probability(padded[k:k + depth], (1 << j) | byte >> (8 - j), byte >> (7 - j) & 1)
                total += math.log10(.5 if p is None else p)
        if (str(i), len(s.split()) + 1) in got:
            assert math.isclose(got[str(i), len(s.split()) + 1], total, rel_tol=1e-5), i


def labelled(spark):
    rng = random.Random(2)
    insults, groups = ["blorgface", "snivelrat", "grubling", "muckbrain"], ["martians", "venusians"]
    rows, labels = [], []
    for i in range(800):
        words = prose(rng, rng.randint(20, 90)).split()
        toxic = i % 5 == 0
        if toxic:
            for w in rng.sample(insults, 2) + rng.sample(groups, 1):
                words.insert(rng.randrange(len(words)), w)
        bad = i % 7 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "&&&" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (1001, ""), (None, prose(rng, 20)), (1002, prose(rng, 20_000)), (0, rows[0][1])]
    labels += [(1000, 1, 0), (1001, None, None), (None, 1, 1), (3, 1, 0)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_classifiers_on_held_out_rows(spark):
    docs, labels, rows, truth = labelled(spark)
    for module, column, at_least in ((toxicity_fm, 2, 0.95), (quality_knn, 1, 0.95)):
        got = module.scored(docs, labels).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert all(r.held_out == held(r.doc_id, 4, 2) for r in got)
        y = {t[0]: t[column] for t in truth if t[0] is not None and t[0] < 900}
        checked = [r.predicted == y[r.doc_id] for r in got if r.held_out and r.doc_id in y]
        assert len(checked) > 100 and sum(checked) / len(checked) >= at_least
        # a score depends on the text alone
        other = module.scored(docs.withColumn("source", F.lit("other")).withColumn("lang", F.lit("xx")), labels).collect()
        assert sorted((str(r.doc_id), round(r.score, 6)) for r in other) == sorted((str(r.doc_id), round(r.score, 6)) for r in got)
        kept = module.accepted(docs, labels)
        assert kept.schema == docs.schema and 0 < kept.count() < docs.count()
        assert module.scored(docs.limit(0), labels).count() == 0
        assert module.scored(docs.limit(5), labels.limit(0)).count() == 5


def test_long_texts_stay_clean_or_toxic(spark):
    docs, labels, _, _ = labelled(spark)
    rng = random.Random(9)
    long = prose(rng, 15_000)
    more = frame(spark, [(5000, long), (5001, long + " Grubling, MUCKBRAIN! martians snivelrat")])
    got = {r.doc_id: r.predicted for r in toxicity_fm.scored(docs.unionByName(more), labels).collect()}
    assert (got[5000], got[5001]) == (0, 1)


def plain_matches(texts, notices, threshold=0.8):
    """(doc, template) whose shingles lie in some window of the template's size at ``threshold``."""
    import re
    cut = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    out = set()
    for t, (_, notice) in enumerate(notices):
        w = cut(notice)
        if not w:
            continue
        n = min(5, len(w))
        want = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
        for i, text in texts:
            x = cut(text or "")
            shingles = [tuple(x[k:k + n]) for k in range(len(x) - n + 1)]
            if any(len(want & set(shingles[k:k + len(want)])) >= threshold * len(want) for k in range(max(1, len(shingles)))):
                out.add((i, t))
    return out


def test_license_scan_against_brute_force(spark, docs, none):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        name, notice = license_scan.NOTICES[k % len(license_scan.NOTICES)]
        words = notice.split()
        if k >= 60 and len(words) > 12:
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, prose(rng, rng.randint(0, 300)) + "\n" + " ".join(words) + "\n" + prose(rng, rng.randint(0, 60))))
    rows += [(500, None), (501, ""), (502, "mit license"), (None, license_scan.NOTICES[1][1])]
    got = {(r.doc_id, r.template) for r in license_scan.scan(frame(spark, rows)).collect()}
    want = plain_matches(rows, license_scan.NOTICES)
    assert want <= got
    assert got - want <= {(i, t) for i, t in got if t > 3}  # regions are a little wider than windows
    spans = license_scan.scan(frame(spark, [(1, "a b " + license_scan.NOTICES[0][1] + " c")])).collect()
    assert [(r.license, r.first_word, r.last_word, r.containment) for r in spans] == [("Apache-2.0", 2, 9, 1.0)]
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(none).count() == 0
    assert license_scan.scan(docs, notices=[("none", "")]).count() == 0


def test_subsequence_against_dynamic_programming():
    rng = random.Random(6)
    for _ in range(300):
        a, b = [rng.randrange(6) for _ in range(rng.randint(1, 20))], [rng.randrange(6) for _ in range(rng.randint(1, 40))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        length, matched = latent_decontamination.common_subsequence(a, b)
        assert length == table[-1][-1] == matched.bit_count()
        rest = iter(b)
        assert all(a[i] in rest for i in range(len(a)) if matched >> i & 1)


def test_benchmark_passages(spark, docs, texts, none):
    rng = random.Random(7)
    items = [(k, prose(rng, rng.randint(12, 60))) for k in range(40)] + [(90, None), (91, ""), (None, prose(rng, 30))]
    planted = []
    for k in range(40):
        words = items[k][1].split()
        if k % 3 == 1:  # a paraphrase: some words changed, the end kept
            for j in rng.sample(range(len(words) * 3 // 4), len(words) // 4):
                words[j] = "zork"
        passage = " ".join(words).upper() if k % 3 == 2 else " ".join(words)
        planted.append((1000 + k, prose(rng, rng.randint(0, 400)) + " " + passage + " " + prose(rng, rng.randint(0, 400))))
    all_docs = docs.unionByName(frame(spark, planted))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in latent_decontamination.decontaminated(all_docs, benchmark).collect()}
    assert all(got[1000 + k].contaminated and k in got[1000 + k]["items"] for k in range(40))
    assert not any(r.contaminated for i, r in got.items() if i is None or i < 1000)
    kept = latent_decontamination.clean(all_docs, benchmark)
    assert kept.schema == docs.schema and kept.count() == len(texts)
    assert latent_decontamination.clean(docs, benchmark.limit(0)).count() == len(texts)
    assert latent_decontamination.decontaminated(none, benchmark).count() == 0


def test_each_benchmark_item_keeps_its_direction(spark, none):
    rng = random.Random(11)
    items = [(k, " ".join(rng.choice("abcdefgh") + str(rng.randrange(2500)) for _ in range(rng.choice([4, 6, 60])))) for k in range(510)]
    copies = frame(spark, [(k, prose(rng, 20) + " " + t + " " + prose(rng, 20)) for k, t in items])
    got = {r.doc_id: r["items"] for r in latent_decontamination.decontaminated(copies, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [k for k, _ in items if k not in got[k]] == []
    blocks = latent_decontamination.blocks_of(spark.range(1000, numPartitions=7), 256, "blocks")
    assert [b.count() for b in blocks] == [256, 256, 256, 232]
    assert sorted(r.id for b in blocks for r in b.collect()) == list(range(1000))
    assert latent_decontamination.blocks_of(none, 256, "blocks") == []


def test_copies_among_rare_words_and_copies_of_long_items(spark):
    rng = random.Random(13)
    common = [prose(rng, 1) for _ in range(40)]
    items = [(k, " ".join(rng.choice(common) if rng.random() < 0.7 else prose(rng, 1) for _ in range(rng.randint(15, 22)))) for k in range(150)]
    items += [(200 + k, " ".join(rng.choice(common) if rng.random() < 0.7 else prose(rng, 1) for _ in range(2500))) for k in range(4)]
    rare = iter(f"x{j}q" for j in range(1_000_000))
    around = lambda n: " ".join(next(rare) for _ in range(n))
    rows = [(k, around(rng.randint(40, 90)) + " " + t + " " + around(60)) for k, t in items]
    rows += [(1000 + k, items[k][1] + " " + " ".join(f"again{k}" for _ in range(60))) for k in range(50)]
    rows += [(5000 + k, " ".join(rng.choice(common) for _ in range(60))) for k in range(400)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in latent_decontamination.decontaminated(frame(spark, rows), benchmark).collect()}
    assert [k for k, _ in items if k not in got[k]["items"]] == [] == [k for k in range(50) if k not in got[1000 + k]["items"]]
    assert all(got[k].subsequence == 1.0 and got[k].cosine <= 1.0 for k, _ in items)


def test_quality_that_lies_in_the_wording_alone(spark):
    rng = random.Random(17)
    good = ["anter", "tionly", "resting", "handor", "stingle", "essen", "theron", "ording", "landes", "tiring"]
    spam = ["cheapo", "winnow", "clickit", "buyers", "freebie", "dealio", "casinos", "lotters", "bonuses", "pillsy"]
    cyrillic = "абвгдежзиклмн", "опрстуфхцчшщы"
    rows, labels = [], []
    for i in range(1200):
        bad = i % 2
        if i % 4 < 2:
            words = [rng.choice(spam if bad and rng.random() < 0.6 else good) for _ in range(rng.randint(30, 60))]
        else:
            words = ["".join(rng.choice(cyrillic[bad]) for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(30, 60))]
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - bad))
    got = quality_knn.scored(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), threshold=0.5).collect()
    for kind in (0, 2):
        right = [r.predicted == 1 - r.doc_id % 2 for r in got if r.held_out and r.doc_id % 4 in (kind, kind + 1)]
        assert len(right) > 100 and sum(right) / len(right) >= 0.95
