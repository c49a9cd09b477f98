"""Inputs that hold the operators' own column names come back as they were; exact bounds lose no passage."""

import random

import numpy as np
import pyarrow as pa
import pytest

from stocktake.llm import fm_index, hypergeometric_shuffle, latent_decontamination, lyndon_runs, quality_knn, simhash_pivots, stripes, toxicity_fm

INTERNAL = ["place__", "id__", "fp", "group__", "first__", "part__", "rank__", "key__", "bucket__", "cuts__", "n__", "before__", "text__", "body",
            "contaminated__", "items__", "score__", "doc", "rid", "key", "words", "mark", "digest", "stretches", "start", "length", "count", "component_id"]


@pytest.fixture(scope="module")
def clashing(spark, texts):
    """Documents whose text is in ``body``; every other column holds its own value in each row."""
    names = [c for c in INTERNAL if c != "body"]
    rows = [(i, t, f"the {n} of row {n}", *[f"{c}-{n}" for c in names]) for n, (i, t) in enumerate(texts[:40])]
    return spark.createDataFrame(rows, "doc_id long, body string, text string, " + ", ".join(f"{c} string" for c in names))


def rows_of(df, columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_clean_keep_one_and_shards_return_the_callers_columns(spark, clashing):
    every = clashing.columns
    whole = rows_of(clashing, every)
    benchmark = spark.createDataFrame([(1, "no document holds these nine odd words at all")], "item_id long, text string")
    kept = latent_decontamination.clean(clashing, benchmark, text_col="body")
    assert kept.columns == every and rows_of(kept, every) == whole
    one = simhash_pivots.keep_one(clashing, text_col="body")
    assert one.columns == every and set(rows_of(one, every)) <= set(whole) and 0 < one.count() <= len(whole)
    dealt = hypergeometric_shuffle.uniform_shards(clashing, shards=3)
    assert dealt.columns == [*every, "shard", "slot"] and rows_of(dealt, every) == whole


@pytest.mark.parametrize("run", [
    lambda d: simhash_pivots.near_duplicates(d, text_col="body"),
    lambda d: lyndon_runs.run_digests(d, text_col="body"),
    lambda d: fm_index.substring_dedup(d, text_col="body"),
    lambda d: stripes.collocations(d, text_col="body", group_col="doc", least=2),
], ids=["simhash", "runs", "substrings", "stripes"])
def test_results_do_not_depend_on_other_columns(clashing, run):
    plain = clashing.select("doc_id", "body", "doc")
    a, b = run(clashing), run(plain)
    assert a.columns == b.columns and rows_of(a, a.columns) == rows_of(b, b.columns)


def test_scored_filters_keep_the_callers_columns(spark, clashing):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    for kept in (toxicity_fm.accepted(clashing, labels, threshold=0.99, text_col="body"), quality_knn.accepted(clashing, labels, threshold=0.01, text_col="body")):
        assert kept.columns == clashing.columns and set(rows_of(kept, clashing.columns)) <= set(rows_of(clashing, clashing.columns))


def test_overlap_keeps_every_window_that_can_match():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(700)]

    def some(n):
        return [vocabulary[min(int(rng.paretovariate(0.5)) - 1, 699)] for _ in range(n)]
    items = [some(rng.choice([1, 2, 7, 15, 30, 48, 49, 90])) for _ in range(40)]
    texts = [some(rng.randint(0, 300)) for _ in range(40)]
    for t in texts:
        copied = rng.choice(items)
        at = rng.randint(0, len(t))
        t[at:at] = [w for w in copied if rng.random() < 0.7]
    hashed = []
    for _, _, word, doc in latent_decontamination.word_hashes(pa.array([" ".join(i) for i in items])):
        hashed += [word[doc == d].tolist() for d in range(len(items))]
    df = np.zeros(1 << latent_decontamination.BITS)
    for t in texts:
        for w in set(t):
            for _, _, word, _ in latent_decontamination.word_hashes(pa.array([w])):
                df[latent_decontamination.slots(word)] += 1
    overlap = latent_decontamination.Overlap(hashed, df, 0.5)
    for _, _, word, doc in latent_decontamination.word_hashes(pa.array([" ".join(t) for t in texts])):
        steps = latent_decontamination.Steps(word, doc)
        window, item = overlap.windows(steps)
        got = set(zip(window.tolist(), item.tolist(), strict=True))
        must = 0
        for s in range(len(steps.starts)):
            for i, words in enumerate(hashed):
                reach = latent_decontamination.spare_words(len(words)) + (len(words) if len(words) > latent_decontamination.PART else 0)
                d = steps.doc[s]
                lo, hi = max(steps.begin[d], steps.starts[s] - reach), min(steps.begin[d + 1], steps.ends[steps.last[s] - 1] + reach)
                there = set(word[lo:hi].tolist())
                if sum(x in there for x in words) >= 0.5 * len(words):
                    must += 1
                    assert (s, i) in got
        assert must > 100 and len(got) < len(steps.starts) * len(items)
