"""Lyndon arrays and periodic runs against their definitions."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stocktake.llm import lyndon_runs


def plain_lyndon(w):
    def lyndon(u):
        return all(u < u[k:] for k in range(1, len(u)))
    return [max(j - i for j in range(i + 1, len(w) + 1) if lyndon(w[i:j])) for i in range(len(w))]


def plain_runs(w, shortest):
    """Every stretch with a period, by trying all periods from the smallest."""
    found = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            first = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - first + q
            stretch = w[first:first + n]
            if i > first and n >= max(shortest, 2 * q) and not any(
                    stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.add((first, n, q))
            i = max(i, first + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w, 12)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


@given(st.lists(st.integers(0, 3), max_size=24))
@settings(max_examples=200, deadline=None)
def test_groups_give_the_lyndon_array(w):
    assert lyndon_runs.lyndon_array(w) == plain_lyndon(w)
    top = max(w, default=0)
    assert lyndon_runs.lyndon_array([top - x for x in w]) == plain_lyndon([top - x for x in w])


@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 40), st.sampled_from([2, 3, 5, 12]))
@settings(max_examples=200, deadline=None)
def test_runs_of_random_and_repeated_words(w, period, shortest):
    for x in (w, [w[i % min(period, len(w))] for i in range(3 * len(w))] if w else w):
        got = lyndon_runs.runs_of(np.array(x, np.int64), np.zeros(len(x), np.int64), shortest)
        assert [tuple(r) for r in got.tolist()] == plain_runs(x, shortest)


def test_known_strings_with_many_runs():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue = "".join(str(bin(i).count("1") % 2) for i in range(512))
    for text in (fibonacci[-1], thue, "a" * 300, "ab" * 100 + "b" + "ba" * 100):
        w = [ord(c) for c in text]
        got = lyndon_runs.runs_of(np.array(w, np.int64), np.zeros(len(w), np.int64), 2)
        assert [tuple(r) for r in got.tolist()] == plain_runs(w, 2)


def test_no_run_crosses_two_texts():
    w = [1, 2] * 6
    owner = np.repeat([0, 1], 6)
    assert lyndon_runs.runs_of(np.array(w, np.int64), owner, 6).tolist() == [[0, 6, 2], [6, 6, 2]]


def test_digests_of_documents(docs, texts, none):
    rng = random.Random(7)
    words = [f"w{rng.randrange(5)}" for _ in range(400)]
    repeated = " ".join(words[:50] + words[:30] * 4 + words[50:] + ["z"] * 40)
    more = docs.sparkSession.createDataFrame([(i, repeated if i % 2 else repeated[:300]) for i in range(1000, 1040)], "doc_id long, text string")
    rows = texts + [tuple(r) for r in more.collect()]
    rows = [(i, " ".join((t or "").split(" ")[:2000]) if t else t) for i, t in rows]
    frame = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS n_runs", "2 AS key")
    got = lyndon_runs.run_digests(frame)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_row(*r)) for r in rows)
    assert lyndon_runs.run_digests(none).count() == 0


def test_long_texts_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(lyndon_runs, "PIECE", 64)
    rng = random.Random(2)
    data = " ".join(f"w{rng.randrange(30)}" for _ in range(500)).encode()
    words = lyndon_runs.Vocabulary()
    ids = words.encode(data)
    assert b"".join(lyndon_runs._joined(list(words), ids)) == data and len(ids) == 500


def test_runs_and_collapsed_texts(spark, none):
    text = "one two " + "a b c d " * 5 + "end\n" + "x " * 13
    df = spark.createDataFrame([(1, text, 5), (2, None, 6), (3, "", 7), (1, text, 5)], "doc_id long, text string, owner int")
    assert sorted(map(tuple, lyndon_runs.runs(df).collect())) == [(1, 2, 20, 4)] * 2 + [(1, 23, 13, 1)] * 2
    out = lyndon_runs.collapsed(df).orderBy("doc_id").collect()
    assert [r.collapsed for r in out] == ["one two a b c d end x"] * 2 + ["", ""] and out[0].owner == 5
    assert lyndon_runs.runs(none).count() == lyndon_runs.collapsed(none).count() == 0
