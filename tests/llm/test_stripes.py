"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stocktake.llm import stripes


def plain_counts(rows, most):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return n, f


def plain_collocations(rows, least, most, percent, top):
    n, f = plain_counts(rows, most)
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, w), a in found.items():
        inside = any(g == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v))) and 100 * b >= percent * a
                     for (g, v), b in found.items())
        if not inside:
            cuts = []
            for k in range(1, len(w)):
                left, right = f[lang, w[:k]], f[lang, w[k:]]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def sample(seed=5):
    rng = random.Random(seed)
    common = ["the of and", "New York City hall", "to be, or not to be", "É à ß", "x\ty", "a\x1cb c"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(common) if rng.random() < 0.3 else rng.choice("abcdefgh") + rng.choice(["", "", "", ".", ";", "\n"]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), " ".join(words)))
    return rows + [("en", None), ("en", ""), ("fr", " \t.,"), (None, None), ("en", "the of and " * 500)] + [("en", "copy of a copy of it")] * 40


@pytest.mark.parametrize("least,most,percent,top", [(5, 5, 100, 2000), (9, 3, 70, 11), (4, 2, 100, 2000), (12, 6, 100, 3), (3, 4, 85, 50)])
def test_against_plain_counting(spark, least, most, percent, top):
    rows = sample()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    got = stripes.collocations(df, least=least, most_words=most, percent=percent, top=top, mask_bits=8)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, most, percent, top)


def test_hot_prefixes_and_small_runs(spark, monkeypatch):
    """Many partial stripes a prefix, every frequent one sliced; run in this process, where the limits can be set."""
    rows = sample(6)
    want_n, f = plain_counts(rows, 5)
    monkeypatch.setattr(stripes, "PIECE", 40)
    parts, mask, single = [], None, None
    for known, lengths in ((0, [0]), (1, [1]), (2, [2]), (3, [3, 4])):
        table = []
        for lang in ("en", "de", "und", "fr"):
            own = [t for g, t in rows if (g or "und") == lang and t is not None]
            for at in range(0, len(own), 7):
                words = stripes.Words(lang)
                for t in own[at:at + 7]:
                    words.add(t.encode())
                hot = np.array([stripes.word_hash(b"en", b"a")], np.uint64) if known == 1 else np.zeros(0, np.uint64)
                table += [r for b in stripes._counted(words, known, lengths, single, mask, hot) for r in b.to_pylist()]
        import pyarrow as pa
        table.sort(key=lambda r: (r["lang"], r["prefix"], r["slice"]))
        schema = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("slice", pa.int32()),
                            ("next", pa.string()), ("count", pa.string())])
        batches = [pa.RecordBatch.from_pylist(table[i:i + 3], schema=schema) for i in range(0, len(table), 3)]
        merged = [r for b in stripes._merged(iter(batches), 5) for r in b.to_pylist()]
        keys = [(r["lang"], r["prefix"], r["slice"]) for r in merged]
        assert len(keys) == len(set(keys))
        words = np.zeros(1 << 10, np.uint64)
        for h in (np.uint64(h % 2**64) for r in merged for h in r["hash"]):
            at = int(h) >> 48
            words[at >> 6] |= np.uint64(1 << (at & 63))
        mask = stripes.Mask(words, 16)
        single = single or mask
        parts += merged
    totals = Counter()
    for r in parts:
        totals[r["lang"], r["prefix"]] += r["total"]
        for w, c in zip(r["next"], r["count"], strict=True):
            assert f[r["lang"], (*filter(None, r["prefix"].split(" ")), w)] == c
    assert {g: c for (g, p), c in totals.items() if p == "" and c} == {g: c for g, c in want_n.items() if c}
    frequent = {(g, " ".join(w)): c for (g, w), c in f.items() if len(w) < 5 and c >= 5}
    assert all(totals[k] == c for k, c in frequent.items())
    assert len({r["slice"] for r in parts if r["lang"] == "en" and r["prefix"] == "a"}) > 3


def test_empty_tables(docs, none):
    assert stripes.collocations(none).count() == 0
    assert stripes.collocations(docs.where("false")).count() == 0
