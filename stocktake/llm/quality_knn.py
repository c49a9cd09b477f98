"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

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
from stocktake.llm.linear import right_singular, summed

#: Hashed terms: of the texts' form, then of their wording.
FORM = 2048
WIDTH = FORM + 6144
#: Texts whose dense rows are held at a time.
ROWS = 256
# Character classes of word shapes: small and capital letters, digits; other ASCII signs stand for
# themselves, and bytes from 128 are left out.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 97, 65, 48, 0


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (texts x WIDTH) of each text's form: shapes of words (runs of a character class as one),
    pairs of neighbouring shapes, words that repeat the one before, and five-word shingles seen
    before in the text; and of its wording: words of letters and digits in lower case, and pairs of
    neighbouring characters of non-Latin scripts."""
    n = len(offsets) - 1
    start, end, doc = W.spans(data, offsets, W.NOT_SPACE)
    if not len(start):
        return np.zeros((n, WIDTH), np.float32)
    shape = CLASS[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[start] = True
    fresh &= shape != 0
    at = np.concatenate(([0], np.cumsum(fresh)))
    shapes = W.span_hash(shape[fresh], at[start], at[end])
    pairs, first = W.shingle_hash(shapes, doc, 2)
    word = W.span_hash(W.lower(data), start, end)
    again = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))
    shingle, s_first = W.shingle_hash(word, doc, 5)
    order = np.lexsort((shingle, doc[s_first]))
    s_doc, shingle = doc[s_first][order], shingle[order]
    seen = np.flatnonzero((shingle[1:] == shingle[:-1]) & (s_doc[1:] == s_doc[:-1]))
    slots = np.concatenate(((shapes >> np.uint64(40)) % np.uint64(FORM - 2), (pairs >> np.uint64(40)) % np.uint64(FORM - 2),
                            np.full(len(again), FORM - 2, np.uint64), np.full(len(seen), FORM - 1, np.uint64))).astype(np.int64)
    wording, w_doc = wordings(data, offsets)
    slots = np.concatenate((slots, wording))
    docs = np.concatenate((doc, doc[first], doc[again], s_doc[seen], w_doc))
    return np.bincount(docs * WIDTH + slots, minlength=n * WIDTH).reshape(n, WIDTH).astype(np.float32)


def wordings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text) of every word, and of every pair of neighbouring characters of scripts from Greek on."""
    data = W.lower(data)
    start, end, doc = W.spans(data, offsets)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # characters' first bytes
    ends = np.append(at[1:], len(data))
    text = np.searchsorted(offsets, at, side="right") - 1
    pair = np.flatnonzero((data[at[:-1]] >= 0xCD) & (data[at[1:]] >= 0xCD) & (text[:-1] == text[1:]))
    hashes = np.concatenate((W.span_hash(data, start, end), W.span_hash(data, at[pair], ends[pair + 1])))
    return (FORM + (hashes >> np.uint64(40)) % np.uint64(WIDTH - FORM)).astype(np.int64), np.concatenate((doc, text[pair]))


def counted(texts: pa.Array):
    """(first text, term counts) of blocks of texts."""
    for at in range(0, len(texts), ROWS):
        for first, data, offsets in W.pieces(texts.slice(at, ROWS)):
            yield at + first, terms(data, offsets)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length one, to which form and wording give the same share."""
    x = np.log1p(counts) * idf
    for half in (x[:, :FORM], x[:, FORM:]):
        half /= np.maximum(np.linalg.norm(half, axis=1, keepdims=True), 1e-12)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Voters:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    y: np.ndarray
    cost: np.ndarray
    prior: float
    neighbours: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.y):
            return out
        k = min(self.neighbours, len(self.y))
        for first, counts in counted(texts):
            cosine = self.project(counts) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.exp(12 * np.take_along_axis(cosine, near, axis=1)) * self.cost[near]
            share = (weight * self.y[near]).sum(axis=1) / weight.sum(axis=1)
            out[first:first + len(counts)] = np.where(counts.any(axis=1), share, self.prior)
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2048, rank: int = 96, neighbours: int = 15,
        id_col: str = "doc_id", text_col: str = "text") -> Voters:
    """Document frequencies and the latent space come from all documents; the voters are at most
    2 * ``per_class`` labelled training rows (``labelled.sample``), weighted to the classes' shares.

    Without labelled rows every score is one half.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def frequency():
        def total(batches):
            df = np.zeros(WIDTH + 1)
            for batch in batches:
                df[WIDTH] += batch.num_rows
                for _, counts in counted(text_array(batch, "text")):
                    df[:WIDTH] += (counts > 0).sum(axis=0)
            return df
        return total

    df = summed(texts, frequency, WIDTH + 1)
    idf = (np.log((1 + df[WIDTH]) / (1 + df[:WIDTH])) + 0.1).astype(np.float32)

    def blocks():
        def rows(batches):
            for batch in batches:
                for _, counts in counted(text_array(batch, "text")):
                    yield weighted(counts, idf)
        return rows

    basis = right_singular(texts, blocks, WIDTH, rank)
    voters = Voters(idf, basis, np.zeros((0, rank), np.float32), np.zeros(0), np.zeros(0), 0.5, neighbours)
    chosen, sizes = sample(docs, labels, label, per_class, id_col, text_col)

    def vectors(batches):
        for batch in batches:
            y = batch.column(1)
            for first, counts in counted(text_array(batch, "text")):
                z = voters.project(counts).astype("<f4")
                yield pa.RecordBatch.from_arrays([y.slice(first, len(z)), pa.array([v.tobytes() for v in z], pa.binary())], ["y", "v"])

    got = sorted((int(y), bytes(v)) for y, v in stored(chosen.mapInArrow(vectors, "y int, v binary"), "quality-voters").collect())
    if got:
        voters.y = np.array([r[0] for r in got], np.float64)
        voters.vectors = np.stack([np.frombuffer(r[1], "<f4") for r in got])
        total = max(1, sum(sizes.values()))
        here = {v: max(1, int((voters.y == v).sum())) for v in (0, 1)}
        voters.cost = np.where(voters.y == 1, sizes.get(1, 0) / here[1], sizes.get(0, 0) / here[0]) / total
        voters.prior = sizes.get(1, 0) / total
    return voters


def with_scores(docs: DataFrame, voters: Voters, name: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the similarity-weighted vote (0 to 1) on each whole text in column ``name``.

    Exact cosines of blocks of documents with every voter; the broadcast voters are bounded by
    their parameters. Null and empty texts get the classes' share.
    """
    model = docs.sparkSession.sparkContext.broadcast(voters)
    return append_columns(docs, text_col, [StructField(name, DoubleType())],
                          lambda: lambda texts: [pa.array(model.value.score(texts), pa.float64())], keep)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 if score >= ``threshold``).

    Null ids are never held out; repeated rows are scored alike; an empty table gives no rows.
    """
    voters = fit(docs, labels, id_col=id_col, text_col=text_col, **params)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_scores(rows, voters, "score", "text", ["doc_id"]).select(
        "doc_id", held_out_rows("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, unchanged."""
    score = free_name(docs, "quality")
    voters = fit(docs, labels, id_col=id_col, text_col=text_col, **params)
    return with_scores(docs, voters, score, text_col).where(F.col(score) >= threshold).drop(score)
