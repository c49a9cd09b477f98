"""Language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm import words as W
from stocktake.llm.common import held_out_rows, stored, text_array

#: Bytes of context. A key holds them nearest first, then the byte that follows: DEPTH + 1 bytes.
DEPTH = 5
#: Contexts of so many bytes root the subtrees that one task weighs. A subtree has 256**(DEPTH + 1 - ROOT)
#: keys at most, and above the roots there are 256**(ROOT - 1) contexts, whatever the corpus.
ROOT = 3
#: Bytes of text in a block (at least one text).
BLOCK = 32 << 20
#: Bytes of the runs of texts that are worked on at a time.
RUN = 1 << 20
#: Set in the keys of words (63 bits of their hash); the keys of bytes are below it.
WORD = np.uint64(1 << 63)
#: Entries gathered before they are added up.
GATHERED = 1 << 20


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0 (Stirling's series beyond a shift by 8)."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a block of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1)


class Nodes:
    """Nodes of one depth for one bit of the byte: ids (context, then the byte's bits so far behind a
    leading 1), their counts, ln of the weighted probability and the weight of stopping here."""

    def __init__(self, ids, n0, n1, below=None):
        self.ids, self.n0, self.n1 = ids, n0, n1
        here = log_kt(n0, n1)
        self.log_weighted = here if below is None else np.log(0.5) + np.logaddexp(here, below)
        self.stop = np.ones(len(ids)) if below is None else np.exp(np.log(0.5) + here - self.log_weighted)

    def mixed(self, ids: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of ``bit`` at each id: the node's estimate mixed with that of the deeper nodes (NaN:
        none was ever visited); ids that were never visited pass the deeper one on."""
        if not len(self.ids):
            return deeper
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        seen = self.ids[at] == ids
        estimate = (np.where(bit, self.n1[at], self.n0[at]) + 0.5) / (self.n0[at] + self.n1[at] + 1)
        stop = self.stop[at]
        mix = np.where(np.isnan(deeper), estimate, stop * estimate + (1 - stop) * deeper)
        return np.where(seen, mix, deeper)


def parent(ids: np.ndarray) -> np.ndarray:
    """The same bits under the context without its farthest byte."""
    return ((ids >> np.uint64(16)) << np.uint64(8)) | (ids & np.uint64(255))


def bit_nodes(keys: np.ndarray, n: np.ndarray, j: int):
    """(ids, zeros, ones) of the nodes of bit ``j`` for sorted (context, byte) keys with counts."""
    byte = keys & np.uint64(255)
    ids = ((keys >> np.uint64(8)) << np.uint64(8)) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))
    one = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.float64) * n
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    n1 = np.add.reduceat(one, first)
    return ids[first], np.add.reduceat(n.astype(np.float64), first) - n1, n1


def below(children: Nodes, ids: np.ndarray) -> np.ndarray:
    return np.bincount(np.searchsorted(ids, parent(children.ids)), children.log_weighted, minlength=len(ids))


def subtrees(keys: np.ndarray, n: np.ndarray):
    """Whole subtrees' sorted keys and counts -> (probabilities of each key's 8 bits from ROOT down, NaN if
    never visited; for each bit the roots' nodes)."""
    out = np.full((len(keys), 8), np.nan, np.float64)
    roots: list[Nodes] = []
    trained = n > 0
    tree, count = keys[trained], n[trained]
    for j in range(8):
        byte = keys & np.uint64(255)
        bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        low, probability, nodes = np.uint64(1 << j) | (byte >> np.uint64(8 - j)), out[:, j], None
        for depth in range(DEPTH, ROOT - 1, -1):
            up = np.uint64(8 * (DEPTH - depth + 1))
            at_depth = ((tree >> up) << np.uint64(8)) | (tree & np.uint64(255))
            if depth == DEPTH:
                level, total = at_depth, count
            else:
                level, where = np.unique(at_depth, return_inverse=True)
                total = np.bincount(where, count, minlength=len(level))
            if not len(level):
                nodes = Nodes(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
                continue
            ids, n0, n1 = bit_nodes(level, total, j)
            nodes = Nodes(ids, n0, n1, below(nodes, ids) if depth < DEPTH else None)
            probability = nodes.mixed(((keys >> up) << np.uint64(8)) | low, bit, probability)
        out[:, j] = probability
        roots.append(nodes)
    return out, roots


class Top:
    """The nodes above the subtrees' roots."""

    def __init__(self, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, deeper: np.ndarray):
        """Sorted ids of depth ROOT - 1 with counts and the sums of ln of their children's weighted probabilities."""
        self.levels = [Nodes(ids, n0, n1, deeper)]
        for _ in range(ROOT - 1):
            child = self.levels[-1]
            up, where = np.unique(parent(child.ids), return_inverse=True)
            self.levels.append(Nodes(up, np.bincount(where, child.n0, minlength=len(up)), np.bincount(where, child.n1, minlength=len(up)),
                                     np.bincount(where, child.log_weighted, minlength=len(up))))

    def log10(self, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """log10 probability of each key's byte after its context."""
        byte, out = keys & np.uint64(255), np.zeros(len(keys))
        for j in range(8):
            probability = bits[:, j].astype(np.float64)
            bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            low = np.uint64(1 << j) | (byte >> np.uint64(8 - j))
            for i, nodes in enumerate(self.levels):
                depth = ROOT - 1 - i
                context = keys >> np.uint64(8 * (DEPTH - depth + 1))
                probability = nodes.mixed((context << np.uint64(8)) | low, bit, probability)
            out += np.log10(np.where(np.isnan(probability), 0.5, probability))
        return out


def normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored (block, doc_id array, held_out array, streams): runs of texts of about RUN bytes in blocks of about BLOCK.

    A text's stream is its words in lower case, a space between them and a line feed behind them;
    a run's streams are compressed together.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out_rows(id_col, 10, 0).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    schema = "block long, doc_id array<long>, held_out array<boolean>, streams binary"

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        part, block, in_block = TaskContext.get().partitionId(), 0, 0
        ids, held, streams, size = [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + block], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                                               pa.array([held], pa.list_(pa.bool_())), pa.array([pack(b"".join(streams))], pa.binary())],
                                              ["block", "doc_id", "held_out", "streams"])

        for batch in batches:
            for i, h, text in zip(batch.column(0), batch.column(1), text_array(batch, "text"), strict=True):
                ids.append(i.as_py())
                held.append(h.as_py())
                streams.append(b" ".join(text.as_py().encode("utf-8", "replace").lower().split()) + b"\n")
                size += len(streams[-1])
                if size >= RUN:
                    yield out()
                    in_block += size
                    ids, held, streams, size = [], [], [], 0
                    if in_block >= BLOCK:
                        block, in_block = block + 1, 0
        if ids:
            yield out()

    return stored(rows.mapInArrow(run, schema), "streams")


def streams_of(packed: bytes) -> list[bytes]:
    """The streams of a run (a line feed ends each, and none holds another)."""
    return [s + b"\n" for s in zstandard.ZstdDecompressor().decompress(packed).split(b"\n")[:-1]]


def grams(streams: list[bytes]):
    """Pieces of (key of every byte, text number): the DEPTH bytes before it, nearest first (zeros before a text), and itself."""
    pad = b"\0" * DEPTH
    data = np.frombuffer(pad + pad.join(streams), np.uint8)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    starts = np.cumsum(sizes + DEPTH) - sizes
    for lo in range(DEPTH, len(data), RUN):
        piece = data[lo - DEPTH:lo + RUN].astype(np.uint64)
        key = piece[DEPTH:].copy()
        for back in range(1, DEPTH + 1):
            key |= piece[DEPTH - back:len(piece) - back] << np.uint64(8 * (DEPTH + 1 - back))
        at = np.arange(lo, lo + len(key))
        text = np.maximum(np.searchsorted(starts, at, side="right") - 1, 0)
        inside = at - starts[text] < sizes[text]
        yield key[inside], text[inside]


def words_of(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, text number) of every word."""
    texts = pa.array(streams, pa.large_binary())
    data, offsets = W.bytes_of(texts)
    start, end, doc = W.spans(data, offsets, W.NOT_SPACE)
    return W.span_hash(data, start, end) | WORD, doc


def tally(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of ``n``."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(n, first) if len(first) else n)


def postings(texts: DataFrame) -> DataFrame:
    """Stored (block, key, n): each block's distinct byte keys and words, and how often its training texts have them."""
    def counts(streams: list[bytes], training: np.ndarray):
        for key, doc in grams(streams):
            # the lowest bit tells training from held-out text, so that one sort of plain numbers is enough
            key = np.sort((key << np.uint64(1)) | training[doc].astype(np.uint64))
            first = np.flatnonzero(np.concatenate(([True], key[1:] >> np.uint64(1) != key[:-1] >> np.uint64(1))))
            yield key[first] >> np.uint64(1), np.add.reduceat((key & np.uint64(1)).astype(np.int64), first)
        key, doc = words_of(streams)
        yield tally(key, training[doc].astype(np.int64))

    def out(block: int, found: list):
        key, n = together(found)
        for at in range(0, len(key), 100_000):
            k = key[at:at + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k), pa.array(n[at:at + 100_000])],
                                             ["block", "key", "n"])

    def run(batches):
        block, found = None, []
        for batch in batches:
            for b, held, packed in zip(*batch.columns, strict=True):
                if b.as_py() != block and found:
                    yield from out(block, found)
                    found = []
                block = b.as_py()
                found += counts(streams_of(packed.as_py()), ~np.array(held.as_py(), bool))
                if sum(len(k) for k, _ in found[1:]) > GATHERED:
                    found = [together(found)]
        if found:
            yield from out(block, found)

    return stored(texts.select("block", "held_out", "streams").mapInArrow(run, "block long, key long, n long"), "postings")


def together(found: list) -> tuple[np.ndarray, np.ndarray]:
    return tally(*(np.concatenate(c) for c in zip(*found, strict=True)))


def gram_scores(posted: DataFrame) -> DataFrame:
    """(key, value): log10 probability of each byte key of the corpus under the tree of its training texts.

    Subtrees are dealt by their roots' contexts and weighed bottom up; the sums of their roots give
    the few nodes above, with which the mixtures are completed.
    """
    schema = "kind byte, key long, n0 double, n1 double, weighted double, bits array<float>"

    def weigh(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        key = np.concatenate([np.asarray(b.column(0)) for b in held]).astype(np.int64).view(np.uint64)
        n = np.concatenate([np.asarray(b.column(1)) for b in held])
        order = np.argsort(key)
        key, n = key[order], n[order]
        bits, roots = subtrees(key, n)
        for at in range(0, len(key), 100_000):
            k = key[at:at + 100_000].view(np.int64)
            nothing = pa.nulls(len(k), pa.float64())
            flat = pa.array(bits[at:at + len(k)].reshape(-1), pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k), np.int8)), pa.array(k), nothing, nothing, nothing,
                                              pa.ListArray.from_arrays(np.arange(0, 8 * len(k) + 1, 8, dtype=np.int32), flat)],
                                             ["kind", "key", "n0", "n1", "weighted", "bits"])
        for nodes in roots:
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(nodes.ids), np.int8)), pa.array(nodes.ids.view(np.int64)), pa.array(nodes.n0),
                                              pa.array(nodes.n1), pa.array(nodes.log_weighted), pa.nulls(len(nodes.ids), pa.list_(pa.float32()))],
                                             ["kind", "key", "n0", "n1", "weighted", "bits"])

    counted = posted.where("key >= 0").groupBy("key").agg(F.sum("n").alias("n"))
    counted = counted.repartition(F.shiftright("key", 8 * (DEPTH + 1 - ROOT)))
    weighed = stored(counted.mapInArrow(weigh, schema), "subtrees")
    up = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    roots = weighed.where("kind = 1").groupBy(up.alias("id")).agg(F.sum("n0"), F.sum("n1"), F.sum("weighted")).orderBy("id").collect()
    ids = np.array([r[0] for r in roots], np.int64).view(np.uint64)
    top = posted.sparkSession.sparkContext.broadcast(Top(ids, *(np.array([r[i] for r in roots], np.float64) for i in (1, 2, 3))))

    def finish(batches):
        for batch in batches:
            key = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            bits = np.asarray(batch.column(1).flatten()).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top.value.log10(key, bits))], ["key", "value"])

    return weighed.where("kind = 0").select("key", "bits").mapInArrow(finish, "key long, value double")


class Table:
    """Values by 64-bit key: one probe of a table twice as large or more, a binary search for what another key displaced."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        slot = self._slot(self.keys)
        self.at = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.at[slot] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys):
        return ((keys * W.BASE) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.at[self._slot(keys)]
        lost = np.flatnonzero(self.keys[at] != keys)
        if len(lost):
            at[lost] = np.minimum(np.searchsorted(self.keys, keys[lost]), len(self.keys) - 1)
            if (self.keys[at[lost]] != keys[lost]).any():
                raise RuntimeError("a block's texts and keys differ")
        return self.values[at]


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model reads a text as its words in lower case, a space between them and a line feed as the
    end, byte by byte, each byte as eight binary decisions. Every decision has a context tree over
    the DEPTH bytes before; a node estimates by Krichevsky-Trofimov from the training texts' counts, and
    the estimates of all depths are mixed by the context-tree weights. Contexts that no training
    text has fall back on their longest visited suffix, decisions never seen on one half.

    Documents stay in stored blocks. Each block's distinct keys and words are counted, scored
    once, joined back to the blocks that have them, and meet the block's texts again; so rows that
    travel are a block's distinct keys, not its bytes. Null texts are empty (the end alone), null ids
    are training texts, repeated rows are counted and scored each; an empty table gives no rows.
    """
    texts = normalised(docs, id_col, text_col)
    posted = postings(texts)
    ends = texts.agg(F.sum(F.size(F.expr("filter(held_out, h -> not h)")))).first()[0] or 0
    words = stored(posted.where("key < 0").groupBy("key").agg(F.sum("n").cast("double").alias("value")), "word-counts")
    total, known = words.where("value > 0").agg(F.coalesce(F.sum("value"), F.lit(0.0)), F.count(F.lit(1))).first()
    train, distinct = int(total) + ends, int(known) + (ends > 0)
    none = F.lit(None)
    values = gram_scores(posted).select("key", F.col("value").cast("float").alias("log10_p"), none.cast("double").alias("known")).unionByName(
        words.select("key", none.cast("float").alias("log10_p"), F.col("value").alias("known")))
    valued = posted.select("block", "key").join(values, "key").select("block", "key", "log10_p", "known")
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
              "bits_per_byte double")
    rest = np.log10(train + 0.1 * (distinct + 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        key = np.asarray(right["key"]).astype(np.int64).view(np.uint64)
        is_word = key >= WORD
        gram = Table(key[~is_word], np.asarray(right["log10_p"])[~is_word])
        word = Table(key[is_word], np.asarray(right["known"])[is_word])
        out = []
        for ids, held, packed in zip(left["doc_id"], left["held_out"], left["streams"], strict=True):
            streams = streams_of(packed.as_py())
            n = len(streams)
            total, base, known = np.zeros(n), np.full(n, np.log10(ends + 0.1) - rest), np.full(n, int(ends > 0))
            for keys, doc in grams(streams):
                total += np.bincount(doc, gram[keys], minlength=n)
            keys, doc = words_of(streams)
            if len(keys):
                c = word[keys]
                base += np.bincount(doc, np.log10(c + 0.1) - rest, minlength=n)
                known += np.bincount(doc, c > 0, minlength=n).astype(np.int64)
            sizes = np.fromiter(map(len, streams), np.int64, n)
            out.append(pa.table({
                "doc_id": ids.values, "held_out": held.values, "n_tokens": pa.array(np.bincount(doc, minlength=n) + 1, pa.int64()),
                "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(n, train), pa.int64()), "base_score": base, "score": total,
                "bits_per_byte": -total / sizes * np.log2(10)}))
        return pa.concat_tables(out)

    return texts.groupBy("block").cogroup(valued.groupBy("block")).applyInArrow(score, schema)
