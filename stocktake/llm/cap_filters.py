"""Embedding near-duplicates through spherical-cap filters of structured random product codes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm.common import stored
from stocktake.llm.components import components

#: Independent product codes, and the directions of each half of one. A filter is a direction of the first
#: half with one of the second, so there are CODES * DIRECTIONS**2 filters.
CODES = 16
DIRECTIONS = 64
#: A vector is on a filter's cap if its product with the filter's direction is so many standard
#: deviations. With 64 components a vector is on 32 caps on average, and two at cosine 0.95 share 18.
#: Far larger tables than 10**6 vectors want a larger code and greater height.
HEIGHT = 3.2
#: Members of a filter compared in one block; larger filters are cut into chunks that meet pairwise.
CHUNK = 512


@lru_cache(maxsize=4)
def codes(dim: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each code a random rotation and random unit directions of the first and the second half."""
    out = []
    for c in range(CODES):
        rng = np.random.default_rng([seed, dim, c])
        halves = [rng.standard_normal((DIRECTIONS, max(n, 1))) for n in (dim // 2, dim - dim // 2)]
        out.append((np.linalg.qr(rng.standard_normal((dim, dim)))[0], *(h / np.linalg.norm(h, axis=1, keepdims=True) for h in halves)))
    return out


def caps(x: np.ndarray) -> list[np.ndarray]:
    """For each unit row of ``x`` the sorted numbers of all filters on whose cap it lies (list decoding).

    A filter's product is the sum of its halves' products. Directions of the first half that fall
    short even with the best of the second are dropped, the others are read against all of the
    second. A vector on no cap gets the best filter of the first code.
    """
    half, least = x.shape[1] // 2, HEIGHT / np.sqrt(x.shape[1]) * np.sqrt(2)
    rows, filters = [], []
    best = np.zeros(len(x), np.int64)
    for c, (turn, a, b) in enumerate(codes(x.shape[1])):
        z = x @ turn
        u, v = (z[:, :half] @ a.T if half else np.zeros((len(x), DIRECTIONS))), z[:, half:] @ b.T
        if c == 0:
            best = u.argmax(axis=1) * DIRECTIONS + v.argmax(axis=1)
        row, first = np.nonzero(u >= least - v.max(axis=1)[:, None])
        k, second = np.nonzero(v[row] >= (least - u[row, first])[:, None])
        rows.append(row[k])
        filters.append((c * DIRECTIONS + first[k]) * DIRECTIONS + second)
    row, found = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    edges = np.searchsorted(row, np.arange(len(x) + 1))
    return [found[lo:hi] if hi > lo else best[i:i + 1] for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _number(vectors: DataFrame) -> str:
    """How a component is written: as it is if it is a float, else in double precision."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def _cells(vectors: DataFrame) -> DataFrame:
    """Distinct vectors (row, copies, embedding) -> one row for each cell of each filter they are on."""
    schema = "dim int, row long, copies long, vector binary, filters binary, filter array<long>"
    number = _number(vectors)

    def decode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = [np.asarray(v, dtype=number) for v in part.column(2).to_pylist()]
                lists: list = [None] * len(x)
                for dim in {len(v) for v in x}:
                    here = [i for i, v in enumerate(x) if len(v) == dim]
                    for i, f in zip(here, caps(_unit(np.stack([x[i] for i in here]))), strict=True):
                        lists[i] = f
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(v) for v in x], pa.int32()), part.column(0), part.column(1), pa.array([v.tobytes() for v in x], pa.binary()),
                    pa.array([f.astype("<i4").tobytes() for f in lists], pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                    ["dim", "row", "copies", "vector", "filters", "filter"])

    coded = stored(vectors.select("row", "copies", "embedding").mapInArrow(decode, schema), "caps")
    posting = coded.select("dim", "row", F.explode("filter").alias("filter"))
    many = posting.groupBy("dim", "filter").count().where("count > 1").select(
        "dim", "filter", F.ceil(F.col("count") / F.lit(float(CHUNK))).cast("int").alias("chunks"))
    met = coded.select("dim", "row", "copies", "vector", "filters", F.explode("filter").alias("filter")).join(many, ["dim", "filter"])
    met = met.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    met = met.withColumn("k", F.explode(F.expr("sequence(0, chunks - 1)")))
    return met.select("dim", "filter", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"), "chunk", "row", "copies",
                      "vector", "filters")


def _first_common(f: np.ndarray, i: np.ndarray, j: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether the smallest filter on both lists of each pair is ``here`` (lists padded with -1 and -2)."""
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 8192):
        a, b = f[i[at:at + 8192]], f[j[at:at + 8192]]
        both = (a[:, :, None] == np.where(b < 0, -2, b)[:, None, :]).any(axis=2) & (a >= 0)
        out[at:at + 8192] = np.where(both, a, np.iinfo(np.int64).max).min(axis=1) == here[at:at + 8192]
    return out


def _pairs(cell: np.ndarray, chunk: np.ndarray, i_of: np.ndarray, j_of: np.ndarray):
    """Runs of pairs (positions) that meet in their cell: within the chunk of a cell (i, i), else across its two chunks."""
    edges = np.concatenate((np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), [len(cell)]))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi - lo < 2:
            continue
        if i_of[lo] == j_of[lo]:
            a, b = np.triu_indices(hi - lo, 1)
            yield lo + a, lo + b
        else:
            left = lo + np.flatnonzero(chunk[lo:hi] == i_of[lo])
            right = lo + np.flatnonzero(chunk[lo:hi] == j_of[lo])
            yield np.repeat(left, len(right)), np.tile(right, len(left))


def _linked(batch: pa.Table, threshold: float, number: str):
    """(row, other, n) of whole cells: each row's links (weighted by copies) and a spanning star of each local component."""
    col = {n: batch.column(n) for n in batch.column_names}
    dims = np.asarray(col["dim"])
    key = [np.asarray(col[n]) for n in ("filter", "i", "j", "chunk", "row", "copies")]
    cell = np.cumsum(np.concatenate(([0], (np.diff(dims) != 0) | (np.diff(key[0]) != 0) | (np.diff(key[1]) != 0) | (np.diff(key[2]) != 0))))
    vectors, raw = col["vector"].to_pylist(), col["filters"].to_pylist()
    lists = [np.frombuffer(r, "<i4") for r in raw]
    f = np.full((len(lists), max(map(len, lists))), -1, np.int64)
    for r, x in enumerate(lists):
        f[r, :len(x)] = x
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        x = _unit(np.frombuffer(b"".join(vectors[r] for r in at), number).reshape(len(at), dim))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for pair in _pairs(cell[at], key[3][at], key[1][at], key[2][at]):
            waiting.append(pair)
            n += len(pair[0])
            if n > 50_000:
                found += _close(x, at, waiting, f, key[0], threshold)
                waiting, n = [], 0
        if waiting:
            found += _close(x, at, waiting, f, key[0], threshold)
    if not found:
        return None
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    u, v, w = key[4][i], key[4][j], key[5]
    rows, n = np.concatenate((u, v)), np.concatenate((w[j], w[i]))
    names, where = np.unique(rows, return_inverse=True)
    a, b = where[:len(u)], where[len(u):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return names, names[label], np.bincount(where, n).astype(np.int64)


def _close(x, at, waiting, f, filters, threshold):
    i, j = (np.concatenate(c) for c in zip(*waiting, strict=True))
    near = np.concatenate([np.einsum("nd,nd->n", x[i[k:k + 20_000]], x[j[k:k + 20_000]]) for k in range(0, len(i), 20_000)]) >= threshold
    i, j = at[i[near]], at[j[near]]
    keep = _first_common(f, i, j, filters[i])
    return [(i[keep], j[keep])] if keep.any() else []


def links(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Distinct vectors (row, copies, embedding) -> (row, other, n): n links (copies counted) that one
    part of the join found for ``row``, and a row of the same component.

    Vectors meet on the filters both exceed; a filter's members are compared in cells of two chunks
    of about CHUNK vectors, so no task holds a large filter. A pair counts in the cell of its
    smallest common filter only. Cells leave counts and spanning stars, never their pairs.
    """
    number = _number(vectors)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [np.asarray(batch.column(k)) for k in range(4)]
            last = batch.num_rows - 1
            same = np.ones(batch.num_rows, bool)
            for k in key:
                same &= k == k[last]
            cut = int(np.argmax(same))  # the last cell may go on in the next batch
            if cut == 0 and held and all(np.asarray(held[-1].column(k))[-1] == key[k][0] for k in range(4)):
                held.append(batch)
                continue
            yield from _out(held + ([batch.slice(0, cut)] if cut else []), threshold, number)
            held = [batch.slice(cut)]
        yield from _out(held, threshold, number)

    cells = _cells(vectors).repartition("dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j")
    return cells.mapInArrow(run, "row long, other long, n long")


def _out(held: list[pa.RecordBatch], threshold: float, number: str):
    got = _linked(pa.Table.from_batches(held), threshold, number) if held else None
    if got is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["row", "other", "n"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links (vectors at ``threshold`` cosine or more), component_id (smallest
    id reachable), kept (whether it is that one).

    Vectors that are null, zero, or hold a null or non-finite component link with nothing and are
    kept, as are vectors of other lengths among themselves. Equal vectors are one for the search
    and linked by definition. A null id takes its component's smallest; rows that repeat an id are
    each counted. Pairs between caps may be missed with small probability, none below the threshold is
    linked.
    """
    rows = stored(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                                 F.col(vector_col).alias("embedding")), "vectors")
    sound = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
                   " and exists(embedding, x -> x <> 0)")
    classes = stored(rows.where(sound).groupBy("embedding").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"),
                                                              F.min("vec_id").alias("low")), "vector-classes")
    found = stored(links(classes, threshold), "cap-links")
    degree = found.groupBy("row").agg(F.sum("n").alias("n"))
    member = components(found.select(F.col("row").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("row"), "component")
    known = classes.join(degree, "row", "left").join(member, "row", "left").select(
        "embedding", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "row").alias("component"))
    low = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(low, "component").select("embedding", "n_links", "component_id")
    linked = rows.where(sound).join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id",
                                            F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
