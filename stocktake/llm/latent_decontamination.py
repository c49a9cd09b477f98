"""Benchmark decontamination by latent semantic retrieval and subsequence checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField

from stocktake.llm import words as W
from stocktake.llm.common import append_columns, free_name, stored, text_array
from stocktake.llm.linear import right_singular, summed

#: log2 of the hashed terms.
BITS = 18
#: Passages are PASSAGE steps of STEP words, one beginning at every step.
STEP, PASSAGE = 16, 4
#: Longest part of an item; any window of STEP * PASSAGE words that begins up to a step before it holds it whole.
PART = STEP * (PASSAGE - 1)
#: Parts of benchmark items in one index at most.
PARTS = 256


def word_hashes(texts: pa.Array):
    """(first text, number of texts, word hashes, the words' texts) of each piece: letters and digits, lower case."""
    for first, data, offsets in W.pieces(texts):
        data = W.lower(data)
        start, end, doc = W.spans(data, offsets)
        yield first, len(offsets) - 1, W.span_hash(data, start, end), doc


def slots(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(64 - BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, float]:
    """In how many of all documents each hashed term occurs, and their number."""
    def make():
        def total(batches):
            out = np.zeros((1 << BITS) + 1)
            for batch in batches:
                out[-1] += batch.num_rows
                for _, _, word, doc in word_hashes(text_array(batch, "text")):
                    pair = W.distinct((doc << BITS) | slots(word))
                    out[:-1] += np.bincount(pair & ((1 << BITS) - 1), minlength=1 << BITS)
            return out
        return total

    got = summed(docs, make, (1 << BITS) + 1)
    return got[:-1], got[-1]


def common_subsequence(a: list[int], b: list[int]) -> tuple[int, int]:
    """(length of the longest common subsequence, bits of the words of ``a`` on one such), bit-parallel."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    rows = []
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    matched, i, j = 0, len(a), len(b)
    length = len(a) - row.bit_count()
    # walk back: a zero bit at i - 1 after b[:j] says that a[:i] gained a match there
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        elif j == 1 or rows[j - 2] >> (i - 1) & 1:
            matched |= 1 << (i - 1)
            i -= 1
            j -= 1
    return length, matched


def spare_words(length: int) -> int:
    """Words on both sides of a passage that are read with it for an item of ``length`` words."""
    return max(1, length // 2)


class Steps:
    """The texts of one piece in steps of STEP words; a window is a step and the PASSAGE - 1 after it in its text."""

    def __init__(self, word: np.ndarray, doc: np.ndarray):
        self.word = word
        self.begin = np.searchsorted(doc, np.arange(doc[-1] + 2))
        within = np.arange(len(word)) - self.begin[doc]
        first = within % STEP == 0
        self.starts = np.flatnonzero(first)
        self.of_word = np.cumsum(first) - 1
        self.ends = np.append(self.starts[1:], len(word))
        self.doc = doc[self.starts]
        self.last = np.minimum(np.arange(len(self.starts)) + PASSAGE, np.searchsorted(self.doc, self.doc, side="right"))


class Level:
    """The items' words as a bit mask of the ``common`` commonest ones and posting lists of the others.

    Word occurrences are counted by stretches of steps: common words once each, the others as often as
    they occur, so a count is never below the number of an item's words that a stretch holds.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], words: int, common: int):
        self.common = common
        planes = max([1] + [int(c[w < common].max(initial=0)) for w, c in counts])
        self.masks = np.zeros((planes, len(counts), common // 64), np.uint64)  # plane k: words the item holds more than k times
        posting: list[tuple[int, int, int]] = []
        for i, (w, c) in enumerate(counts):
            for x, n in zip(w.tolist(), c.tolist(), strict=True):
                if x < common:
                    self.masks[:n, i, x // 64] |= np.uint64(1 << x % 64)
                else:
                    posting.append((x, i, n))
        posting.sort()
        self.item, self.times = (np.array([p[k] for p in posting], np.int64) for k in (1, 2))
        self.offsets = np.searchsorted(np.array([p[0] for p in posting], np.int64), np.arange(words + 1))

    def read(self, text: Steps, number: np.ndarray, span: int) -> None:
        """Take up a piece: bits of each step, and the other words' places by (item, step)."""
        n = len(text.starts)
        known = np.flatnonzero((number >= 0) & (number < self.common))
        flags = np.zeros((n, self.common), bool)
        flags[text.of_word[known], number[known]] = True
        self.bits = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
        rare = np.flatnonzero(number >= self.common)
        lists = self.offsets[number[rare] + 1] - self.offsets[number[rare]]
        at = np.repeat(self.offsets[number[rare]] - (np.cumsum(lists) - lists), lists) + np.arange(lists.sum())
        code, times = self.item[at] * span + np.repeat(text.of_word[rare], lists), self.times[at]
        order = np.argsort(code, kind="stable")
        self.span, self.code, self.sums = span, code[order], np.concatenate(([0], np.cumsum(times[order])))

    def common_words(self, mask: np.ndarray, item: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(mask & plane[item]).sum(axis=-1, dtype=np.int64) for plane in self.masks)

    def other_words(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.sums[np.searchsorted(self.code, high, side="right")] - self.sums[np.searchsorted(self.code, low, side="left")]

    def around(self, window: np.ndarray, item: np.ndarray, side: int) -> np.ndarray:
        """Words of the item in the window and ``side`` steps on both sides of it."""
        width = PASSAGE + 2 * side
        low = item * self.span + np.maximum(window - side, 0)
        high = np.minimum(item * self.span + window - side + width, (item + 1) * self.span) - 1
        return self.other_words(low, high) + self.common_words(_spread(self.bits, width)[window - side + width - 1], item)


class Overlap:
    """Which windows can hold an item at all: those whose surroundings hold enough of the item's words.

    A confirmed match has a subsequence of ``least`` of the item's words within the window and the words read around it, so
    as many of them stand there. Counts that are never too low (``Level``) keep every such pair: with 64 common words to
    find the pairs, with 512 to look at them again.
    """

    def __init__(self, items: list[list[int]], df: np.ndarray, least: float):
        words = np.unique(np.array([w for item in items for w in item], np.uint64))
        words = words[np.lexsort((words, -df[slots(words)]))]  # commonest first
        number = {w: i for i, w in enumerate(words.tolist())}
        self.words, self.by_hash = words, np.argsort(words)
        self.sorted = words[self.by_hash]
        slot = slots(words)
        self.first = np.full(1 << BITS, -1, np.int32)  # slot -> word; -2: several
        self.first[slot] = np.arange(len(words))
        self.first[np.flatnonzero(np.bincount(slot, minlength=1 << BITS) > 1)] = -2
        counts = [np.unique([number[w] for w in item], return_counts=True) for item in items]
        self.rough, self.fine = (Level(counts, len(words), common) for common in (64, 512))
        self.need = np.array([int(np.ceil(least * len(item) - 1e-9)) for item in items])
        # steps that a window's surroundings reach to each side
        size = np.array([len(item) for item in items])
        self.side = -(-(np.array([spare_words(n) for n in size]) + np.where(size > PART, size, 0)) // STEP)

    def _numbers(self, word: np.ndarray) -> np.ndarray:
        out = self.first[slots(word)]
        several = np.flatnonzero(out == -2)
        if len(several):
            at = np.minimum(np.searchsorted(self.sorted, word[several]), len(self.sorted) - 1)
            out[several] = self.by_hash[at]
        known = np.flatnonzero(out >= 0)
        out[known[self.words[out[known]] != word[known]]] = -1
        return out

    def windows(self, text: Steps) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs that may match."""
        n, number, rough = len(text.starts), self._numbers(text.word), self.rough
        span = n + 2 * int(self.side.max()) + 2 * PASSAGE  # items' codes are further apart than any stretch is long
        for level in (rough, self.fine):
            level.read(text, number, span)
        code, sums, pairs = rough.code, rough.sums, [np.zeros(0, np.int64)]
        for side in np.unique(self.side).tolist():
            width = PASSAGE + 2 * side
            own = np.flatnonzero(self.side == side)
            here = _spread(rough.bits, width)  # of the stretch that ends at a step, which may lie behind the last
            wide = _spread(here, width)  # of all stretches that hold the step one stretch length before
            lo = np.concatenate([np.arange(*np.searchsorted(code, [i * span, (i + 1) * span])) for i in own])
            heads = lo[np.concatenate(([True], code[lo[1:]] != code[lo[:-1]]))] if len(lo) else lo
            item, step = code[heads] // span, code[heads] % span
            # every stretch that holds other words of the item begins some steps before the first of them
            others = sums[np.searchsorted(code, code[heads] + width - 1, side="right")] - sums[heads]
            some = others + rough.common_words(wide[step + width - 1], item) >= self.need[item]
            item, step = item[some], step[some]
            window = (step[:, None] + np.arange(-(width - 1), 1) + side).ravel()
            pair = np.unique(np.repeat(item, width) * span + np.clip(window, 0, n - 1))
            # and items that common words may make up by themselves
            for i in own[rough.common_words(np.uint64(2 ** 64 - 1), own) >= self.need[own]].tolist():
                alone = rough.common_words(here[np.arange(n) - side + width - 1], np.full(1, i)) >= self.need[i]
                pair = np.append(pair, i * span + np.flatnonzero(alone))
            for level in (rough, self.fine):
                item, window = pair // span, pair % span
                pair = pair[level.around(window, item, side) >= self.need[item]]
            pairs.append(pair)
        pair = np.unique(np.concatenate(pairs))
        return pair % span, pair // span


def _spread(bits: np.ndarray, width: int) -> np.ndarray:
    """For k from 0: the union of places k - width + 1 to k (those there are); width - 1 longer than ``bits``."""
    out = np.concatenate((bits, np.zeros((width - 1, *bits.shape[1:]), bits.dtype)))
    done = 1
    while done < width:
        step = min(done, width - done)
        out[step:] |= out[:-step].copy()
        done += step
    return out


@dataclass
class Index:
    """Parts of benchmark items in the latent space they span."""

    ids: list
    words: list[list[int]]
    parts: list[tuple[int, int, int]]  # item number, first word, number of words
    idf: np.ndarray
    term: np.ndarray  # slot -> term number, or -1
    basis: np.ndarray  # of the latent space; a row of zeros behind the last term
    vectors: np.ndarray  # of the parts in it, of length one
    adds: np.ndarray  # (part, term): what one such word adds to the product with the part's unit vector of terms
    norms: np.ndarray  # the parts' lengths in term space
    overlap: Overlap
    latent: float
    cosine: float
    contained: float
    verbatim: float
    paraphrase: float
    answer: float

    def found(self, text: Steps, window: np.ndarray, item: np.ndarray):
        """(text, item number, cosine, subsequence share, answer share) of every confirmed passage.

        ``window`` and ``item`` are the pairs to compare: windows by their first step, items by number. A pair is checked
        word by word if it is near in the latent space, or if the window's words alone say so: the latent space has
        fewer directions than the benchmark has parts, so it may miss a copy, the product of terms cannot.
        """
        starts, ends, last = text.starts, text.ends, text.last
        parts = [[] for _ in self.ids]
        for p, (t, _, _) in enumerate(self.parts):
            parts[t].append(p)
        lists = np.array([len(p) for p in parts])
        flat, offsets = np.array([p for own in parts for p in own]), np.cumsum(lists) - lists
        count = lists[item]
        part = flat[np.repeat(offsets[item] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        window = np.repeat(window, count)
        hits: dict[tuple[int, int], list] = {}
        for at in range(0, len(window), 2048):
            rows, own = np.unique(window[at:at + 2048], return_inverse=True)
            p = part[at:at + 2048]
            place = starts[rows][:, None] + np.arange(STEP * PASSAGE)
            there = place < ends[last[rows] - 1][:, None]
            slot = slots(text.word[np.where(there, place, 0)])
            term = np.where(there, self.term[slot], -1)
            weight = np.where(there, self.idf[slot], 0).astype(np.float32)
            total = (weight.astype(np.float64) ** 2).sum(axis=1)
            inside = np.where(term >= 0, weight.astype(np.float64) ** 2, 0).sum(axis=1)
            product = self.adds[p[:, None], term[own]].sum(axis=1)
            z = np.einsum("rw,rwk->rk", weight, self.basis[term])
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            latent = np.einsum("rk,rk->r", z[own], self.vectors[p])
            near = (latent >= self.latent) | (product >= self.cosine * np.sqrt(np.maximum(inside, 1e-12))[own]) | (
                product >= self.contained * self.norms[p])
            cosine = np.minimum(1.0, product / np.sqrt(np.maximum(total, 1e-12))[own])
            for k in np.flatnonzero(near).tolist():
                first, (t, offset, length) = int(rows[own[k]]), self.parts[p[k]]
                spare = spare_words(len(self.words[t]))
                hits.setdefault((int(text.doc[first]), t), []).append((
                    int(starts[first]) - offset - spare, int(ends[last[first] - 1]) + len(self.words[t]) - offset - length + spare,
                    float(cosine[k])))
        for (d, t), places in hits.items():
            yield from self._confirmed(d, t, places, text.word, text.begin)

    def _confirmed(self, d, t, places, word, begin):
        item, best = self.words[t], None
        least = min(self.verbatim, self.paraphrase) * len(item)
        if len(item) > PART:  # parts of one copy point to nearly the same place
            regions: list[list] = []
            for lo, hi, cosine in sorted(places):
                if regions and lo - regions[-1][0] <= len(item) // 4:
                    regions[-1][1:] = max(hi, regions[-1][1]), max(cosine, regions[-1][2])
                else:
                    regions.append([lo, hi, cosine])
            places = regions
        for lo, hi, cosine in places:
            lo, hi = max(int(begin[d]), lo), min(int(begin[d + 1]), hi)
            around = word[lo:hi].tolist()
            there = set(around)
            if sum(x in there for x in item) < least:  # no subsequence is longer
                continue
            length, matched = common_subsequence(item, around)
            tail = max(1, len(item) // 4)
            answer = (matched >> (len(item) - tail)).bit_count() / tail
            share = length / len(item)
            if share >= self.verbatim or share >= self.paraphrase and answer >= self.answer:
                best = max(best or (0.0, 0.0, 0.0), (share, answer, cosine))
        if best:
            yield d, t, best[2], best[0], best[1]


def blocks_of(rows: DataFrame, size: int, name: str) -> list[DataFrame]:
    """``rows``, stored once, in blocks of ``size`` rows (the last: what is left), with their ``place``."""
    placed = stored(rows.withColumn("place", F.monotonically_increasing_id()), name)
    counts = sorted(tuple(r) for r in placed.groupBy(F.shiftright("place", 33).alias("part")).count().collect())
    starts, before = [], 0
    for part, count in counts:
        starts += [(part << 33) + k - before for k in range(-(-before // size) * size, before + count, size)]
        before += count
    return [placed.where((F.col("place") >= lo) & (F.col("place") < hi)) for lo, hi in zip(starts, [*starts[1:], (1 << 63) - 1])]


def parts_of(items: DataFrame) -> DataFrame:
    """Items (place, text) cut into even parts of PART words at most: item (its place), first, length, text."""
    def cut(batches):
        for batch in batches:
            place, out = batch.column(0).to_pylist(), []
            for at, data, offsets in W.pieces(text_array(batch, "text")):
                start, end, doc = W.spans(data, offsets)
                begin = np.searchsorted(doc, np.arange(len(offsets)))
                for d in range(len(offsets) - 1):
                    n = int(begin[d + 1] - begin[d])
                    count = -(-n // PART)
                    for k in range(count):
                        lo, hi = n * k // count, n * (k + 1) // count
                        piece = data[start[begin[d] + lo]:end[begin[d] + hi - 1]].tobytes()
                        out.append((place[at + d], lo, hi - lo, piece.decode("utf-8", "replace")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), (
                    pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["item", "first", "length", "text"])

    return items.select("place", "text").mapInArrow(cut, "item long, first long, length long, text string")


def index(items: DataFrame, block: DataFrame, df: np.ndarray, n: float, rank: int = 64, latent: float = 0.6, cosine: float = 0.3, contained: float = 0.4, verbatim: float = 0.8,
          paraphrase: float = 0.5, answer: float = 0.75) -> Index:
    """Randomised SVD of the TF-IDF rows of one block of parts, and the parts in its space.

    Inverse document frequencies are those of the documents. Terms are the hashed words of the parts.
    The parts' rows have length one, so that no direction is dropped as short; ``rank`` directions are kept at most.
    """
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    rows = block.select("item", "first", "length").collect()
    got = items.where(F.col("place").isin(sorted({r[0] for r in rows}))).select("place", "item_id", "text").collect()
    number, ids, texts = {r[0]: i for i, r in enumerate(got)}, [r[1] for r in got], [r[2] for r in got]
    words: list[list[int]] = [[] for _ in texts]
    for first, _, word, doc in word_hashes(pa.array(texts, pa.string())):
        for d, w in zip(doc.tolist(), word.tolist(), strict=True):
            words[first + d].append(w)
    parts = [(number[r[0]], r[1], r[2]) for r in rows]
    own = [slots(np.array(words[t][first:first + length], np.uint64)) for t, first, length in parts]
    vocabulary = np.unique(np.concatenate(own))
    term = np.full(1 << BITS, -1, np.int32)
    term[vocabulary] = np.arange(len(vocabulary))
    rank = max(1, min(rank, len(vocabulary), len(parts)))

    def blocks():
        def rows(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    for _, count, word, doc in word_hashes(text_array(batch.slice(at, 128), "text")):
                        x = np.zeros((count, len(vocabulary)), np.float32)
                        slot = slots(word)
                        np.add.at(x, (doc, term[slot]), idf[slot])
                        yield x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return rows

    basis = right_singular(block.select("text"), blocks, len(vocabulary), rank)
    vectors, norms = np.zeros((len(parts), rank), np.float32), np.zeros(len(parts), np.float32)
    adds = np.zeros((len(parts), len(vocabulary) + 1), np.float32)
    for i, slot in enumerate(own):
        v = (idf[slot][:, None] * basis[term[slot]]).sum(axis=0)
        vectors[i] = v / max(float(np.linalg.norm(v)), 1e-12)
        here, count = np.unique(slot, return_counts=True)
        norms[i] = max(float(np.linalg.norm(count * idf[here])), 1e-12)
        adds[i, term[here]] = count * idf[here] ** 2 / norms[i]
    basis = np.concatenate([basis, np.zeros((1, rank), basis.dtype)]).astype(np.float32)
    return Index(ids, words, parts, idf, term, basis, vectors, adds, norms, Overlap(words, df, min(verbatim, paraphrase)), latent, cosine, contained, verbatim, paraphrase, answer)


FOUND = [StructField("contaminated", BooleanType()), StructField("items", ArrayType(LongType())), StructField("cosine", DoubleType()),
         StructField("subsequence", DoubleType()), StructField("answer", DoubleType())]


def _searched(rows: DataFrame, text: str, benchmark: DataFrame, keep: list[str], names: list[str], item_col: str, item_text: str,
              **limits) -> DataFrame:
    """``keep`` of ``rows`` (with text in ``text``) and the five result columns under ``names``."""
    spark = rows.sparkSession
    df, n = document_frequencies(rows.select(F.col(text).alias("text")))
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    items = stored(items.withColumn("place", F.monotonically_increasing_id()), "benchmark-items")
    indexes = [spark.sparkContext.broadcast(index(items, block, df, n, **limits))
               for block in blocks_of(parts_of(items), PARTS, "benchmark-parts")]

    def make():
        def search(texts: pa.Array) -> list[pa.Array]:
            hit: dict[int, list] = {}
            for first, _, word, doc in word_hashes(texts):
                steps = Steps(word, doc) if len(word) else None
                for shared in indexes if len(word) else ():
                    for d, t, cosine, share, answer in shared.value.found(steps, *shared.value.overlap.windows(steps)):
                        hit.setdefault(first + d, []).append((share, answer, cosine, shared.value.ids[t]))
            best = [max(hit[i], key=lambda h: h[:3]) if i in hit else (0.0, 0.0, 0.0) for i in range(len(texts))]
            return [pa.array([i in hit for i in range(len(texts))]),
                    pa.array([sorted({h[3] for h in hit.get(i, ()) if h[3] is not None}) for i in range(len(texts))], pa.list_(pa.int64())),
                    pa.array([b[2] for b in best], pa.float64()), pa.array([b[0] for b in best], pa.float64()),
                    pa.array([b[1] for b in best], pa.float64())]
        return search

    fields = [StructField(name, f.dataType) for name, f in zip(names, FOUND, strict=True)]
    return append_columns(rows, text, fields, make, keep)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", **limits) -> DataFrame:
    """One row a document: doc_id, contaminated, items (ids found in it), and of the best match its cosine,
    subsequence (share of the item's words on the longest common subsequence with the passage and its
    surroundings) and answer (share of the item's last quarter on it).

    Every document is cut into overlapping passages of 64 words, each compared in the latent space with every item
    of the benchmark, long items in parts of 48 words at most, whose words it and its surroundings hold often
    enough for a match (``Overlap``: exact bounds, so none is lost). Passages at ``cosine`` or
    more, measured by their benchmark terms, are checked word by word, and so are those that hold
    ``contained`` of a part's energy: words around a copy can't lower that, so no copy is missed. A match
    is ``verbatim`` of the words, or ``paraphrase`` of them with ``answer`` of the item's end. The
    benchmark is the query set: it is searched in blocks of PARTS parts, each broadcast; nothing of the
    documents is shuffled but the sums of term counts. Null and empty texts match nothing, nor do
    empty items; null ids and repeated rows are kept; an empty benchmark contaminates nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _searched(rows, "text", benchmark, ["doc_id"], [f.name for f in FOUND], item_col, item_text, **limits)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          **limits) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, unchanged."""
    text = free_name(docs, "text__")
    rows = docs.withColumn(text, docs[text_col].cast("string"))
    names = [free_name(rows, f"{f.name}__") for f in FOUND]
    found = _searched(rows, text, benchmark, docs.columns, names, item_col, item_text, **limits)
    return found.where(~F.col(names[0])).select(*docs.columns)
