"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from stocktake.llm import words as W
from stocktake.llm.common import append_columns, free_name, held_out_rows, stored, text_array
from stocktake.llm.labelled import sample

#: log2 of the hashed terms.
BITS = 20


def term_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) of every term: each word, and the first four and five bytes of longer words."""
    data = W.lower(data)
    start, end, doc = W.spans(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), doc
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data), 8), (1, 1))[start].copy().view(np.uint64).reshape(-1)
    hashes, docs = [W.span_hash(data, start, end)], [doc]
    for n in (4, 5):
        longer = end - start > n
        hashes.append(W.mix((eight[longer] & np.uint64((1 << 8 * n) - 1)) + np.uint64(n)))
        docs.append(doc[longer])
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)


@dataclass
class Machine:
    """bias + sum of weights + half the sum of pairwise products of the factors of a text's terms."""

    index: np.ndarray  # slot -> term number, or -1
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for first, data, offsets in W.pieces(texts):
            slot, doc = term_slots(data, offsets)
            term = self.index[slot]
            known = term >= 0
            n, m = len(offsets) - 1, max(1, len(self.weight))
            pair = W.distinct(doc[known] * m + term[known])
            doc, term = pair // m, pair % m
            linear = np.bincount(doc, self.weight[term] if len(term) else None, minlength=n)
            total = np.zeros((n, self.factor.shape[1]))
            np.add.at(total, doc, self.factor[term])
            square = np.bincount(doc, (self.factor[term] ** 2).sum(axis=1) if len(term) else None, minlength=n)
            z = self.bias + linear + 0.5 * ((total ** 2).sum(axis=1) - square)
            out[first:first + n] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 8192, terms: int = 4096, factors: int = 8,
        least_z: float = 5.0, steps: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fits on at most 2 * ``per_class`` labelled training rows (``labelled.sample``).

    Terms are counted by class on the executors; the ``terms`` hashed terms whose document shares
    differ most between the classes (two-proportion z of at least ``least_z``) enter the machine,
    each present or absent, so a text's length does not dilute its terms. The sampled rows, reduced
    to these terms, are small by both bounds and are fitted by AdaGrad on the driver, weighted to
    the classes' true shares. Without rows of both classes every score is the classes' share.
    """
    chosen, sizes = sample(docs, labels, label, per_class, id_col, text_col)

    def slots(batches):
        for batch in batches:
            y = np.asarray(batch.column(1))
            for first, data, offsets in W.pieces(text_array(batch, "text")):
                slot, doc = term_slots(data, offsets)
                pair = W.distinct((doc << BITS) | slot)
                cut = np.searchsorted(pair, np.arange(len(offsets)) << BITS)
                values = (pair & ((1 << BITS) - 1)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y[first:first + len(offsets) - 1], pa.int32()),
                     pa.array([values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["y", "slots"])

    rows = stored(chosen.mapInArrow(slots, "y int, slots binary"), "toxicity-sample")

    def count(batches):
        n = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for y, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y, np.frombuffer(raw, "<u4")] += 1
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[0, some]), pa.array(n[1, some])], ["slot", "n0", "n1"])

    seen = {int(r[0]): int(r[1]) for r in rows.groupBy("y").count().collect()}
    index = np.full(1 << BITS, -1, np.int32)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not (seen.get(0) and seen.get(1)):
        prior = min(max(share, 1e-6), 1 - 1e-6)
        return Machine(index, float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, factors)))
    n0, n1 = seen[0], seen[1]
    stats = rows.mapInArrow(count, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p = (F.col("n0") + F.col("n1")) / F.lit(float(n0 + n1))
    z = (F.col("n1") / F.lit(float(n1)) - F.col("n0") / F.lit(float(n0))) / F.sqrt(p * (1 - p) * F.lit(1 / n0 + 1 / n1) + F.lit(1e-12))
    best = stats.select("slot", F.abs(z).alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "slot").limit(terms).collect()
    for i, r in enumerate(best):
        index[r[0]] = i

    def active(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [(t := index[np.frombuffer(raw, "<u4")])[t >= 0].astype("<u2").tobytes() for raw in batch.column(1).to_pylist()], pa.binary())],
                ["y", "terms"])

    got = sorted((int(y), bytes(t)) for y, t in rows.mapInArrow(active, "y int, terms binary").collect())
    y = np.array([r[0] for r in got], np.float32)
    x = [np.frombuffer(r[1], "<u2") for r in got]
    cost = np.where(y == 1, share / n1, (1 - share) / n0) * (n0 + n1)
    return _adagrad(index, x, y, cost.astype(np.float32), len(best), factors, steps)


def _adagrad(index, x, y, cost, m, factors, steps, rate=0.5, decay=1e-6, batch=256) -> Machine:
    rng = np.random.default_rng(5)
    prior = float((cost * y).sum() / cost.sum())
    theta = np.concatenate((np.full((1, 1 + factors), 0), np.concatenate((np.zeros((m, 1)), rng.normal(0, 0.05, (m, factors))), axis=1)))
    theta[0, 0] = np.log(prior / (1 - prior))
    past = np.full_like(theta, 1e-6)
    for _ in range(-(-steps // max(1, len(y) // batch))):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            dense = np.zeros((len(rows), m))
            for i, r in enumerate(rows):
                dense[i, x[r]] = 1
            weight, factor = theta[1:, 0], theta[1:, 1:]
            inner = dense @ factor
            z = theta[0, 0] + dense @ weight + 0.5 * ((inner ** 2).sum(axis=1) - dense @ (factor ** 2).sum(axis=1))
            error = cost[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            grad = np.zeros_like(theta)
            grad[0, 0] = error.sum()
            grad[1:, 0] = error @ dense
            grad[1:, 1:] = dense.T @ (error[:, None] * inner) - (error @ dense)[:, None] * factor
            grad[1:] += decay * theta[1:]
            past += grad ** 2
            theta -= rate * grad / np.sqrt(past)
    return Machine(index, float(theta[0, 0]), theta[1:, 0].copy(), theta[1:, 1:].copy())


def with_scores(docs: DataFrame, machine: Machine, name: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text in column ``name``; a narrow map.

    Null and empty texts get the machine's bias. The machine is broadcast: its size is set by its
    parameters, not by the data.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)
    return append_columns(docs, text_col, [StructField(name, DoubleType())],
                          lambda: lambda texts: [pa.array(model.value.score(texts), pa.float64())], keep)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 if score >= ``threshold``).

    Null ids are never held out; repeated rows are scored alike; an empty table gives no rows.
    """
    machine = fit(docs, labels, id_col=id_col, text_col=text_col, **params)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_scores(rows, machine, "score", "text", ["doc_id"]).select(
        "doc_id", held_out_rows("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    score = free_name(docs, "toxicity")
    machine = fit(docs, labels, id_col=id_col, text_col=text_col, **params)
    return with_scores(docs, machine, score, text_col).where(F.col(score) < threshold).drop(score)
