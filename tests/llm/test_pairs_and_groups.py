"""SimHash and embedding near-duplicates against brute force."""

import math
import random

import numpy as np
import xxhash

from stocktake.llm import cap_filters, components, simhash_pivots


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_reachable(keys, links):
    """keys: {node: id or None}; links: pairs of nodes."""
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        root[find(a)] = find(b)
    low = {}
    for k, i in keys.items():
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return {k: low.get(find(k)) for k in keys}


def test_fingerprints_and_groups(docs, texts, none):
    rows = simhash_pivots.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    prints = {}
    for i, t in texts:
        f = plain_fingerprint(t)
        prints[f] = min((x for x in (i, prints.get(f)) if x is not None), default=None)
    links = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    want = smallest_reachable(prints, links)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == sorted(
        (str(i), f"{plain_fingerprint(t):016x}", str(want[plain_fingerprint(t)])) for i, t in texts)
    assert simhash_pivots.near_duplicates(none).count() == 0


def test_links_find_every_pair_within_the_distance(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(150)]
    prints = set(base)
    for f in base:
        for _ in range(4):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 7)):
                g ^= 1 << b
            prints.add(g)
    prints |= {0, (1 << 64) - 1, 1, 3, 7, 15, 31}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    got = {(r.u, r.v) for r in simhash_pivots.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}


def test_one_of_each_group_stays(docs, texts, none):
    kept = simhash_pivots.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    prints = {plain_fingerprint(t) for _, t in texts}
    groups = smallest_reachable(dict(zip(prints, prints)), [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4])
    want = {}
    for i, t in texts:
        g = groups[plain_fingerprint(t)]
        want[g] = min((x for x in (i, want.get(g)) if x is not None), default=None)
    assert sorted(map(str, want.values())) == sorted(str(i) for i, _ in rows)
    assert simhash_pivots.keep_one(none).count() == 0


def test_rows_stay_when_a_later_scan_is_split_otherwise(spark):
    path = spark.conf.get("spark.checkpoint.dir") + "/split-otherwise"
    rng = random.Random(12)
    rows = [(i, f"alone {i} " + " ".join(str(rng.random()) for _ in range(i % 40 + 5))) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 200, 4)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(path)
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(name, "2k")
        kept = simhash_pivots.keep_one(spark.read.parquet(path))
        spark.conf.set(name, "64m")
        assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    finally:
        spark.conf.set(name, before)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (5, None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x: x for e in edges for x in e if x is not None}
    want = smallest_reachable(nodes, [e for e in edges if e[1] is not None])
    ends = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {k: want[k] for k in ends}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_links(vectors, threshold=0.95):
    unit = []
    for v in vectors:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    return {(a, b) for a in range(len(unit)) for b in range(len(unit)) if a < b and unit[a] is not None and unit[b] is not None
            and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold}


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 64))
    x = [c + rng.standard_normal(64) * s for c in centres for s in (0, 0.05, 0.15, 0.22, 0.3)]
    x += [centres[0] + rng.standard_normal(64) * 0.1 for _ in range(300)]
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 64), (902, [float("nan")] + [1.0] * 63), (903, [None] + [1.0] * 63), (904, [1.0, 2.0]), (905, [2.0, 4.0]),
             (906, rows[3][1]), (906, rows[3][1]), (None, rows[3][1]), (907, [1e-30] * 64), (908, [1e30] * 64), (909, [])]
    monkeypatch.setattr(cap_filters, "CHUNK", 64)  # large filters are cut into chunks
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n long")
    got = cap_filters.near_duplicates(df).collect()
    links = plain_links([v for _, v in rows])
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    found = sum(r.n_links for r in got) // 2
    assert len(got) == len(rows) and 0.98 * len(links) <= found <= len(links)
    if found == len(links):
        group = smallest_reachable({k: i for k, (i, _) in enumerate(rows)}, links)
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == sorted(
            (str(i), degree[k], str(group[k]), i == group[k]) for k, (i, _) in enumerate(rows))
    assert cap_filters.near_duplicates(df.limit(0)).count() == 0
