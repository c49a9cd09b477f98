"""Periodic runs in the word sequences of documents, by Baier's grouping.

The first phase of Baier's suffix sorter groups the suffixes by the longest Lyndon word they begin
with, so it yields the Lyndon array with no suffix array behind it. Under an order of the words and
under the reversed order it gives two Lyndon roots at each place; each run has one of them as a root
after its first word, so extending every root to both sides by longest common extensions finds all.

Words that cannot lie in a run are set aside first, which loses nothing: a run of at least ``shortest``
words and two periods agrees with itself, one period on, in ``shortest / 2`` words or more, and the
passages so repeated cover it. A stretch of repeated passages therefore holds each run whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stocktake.llm.common import append_columns
from stocktake.llm.words import BASE, mix

#: Bytes of text taken at a time: runs of whole short texts, or slices of a long text's words.
PIECE = 2 << 20
#: Moduli of the fingerprints that compare passages, and their bases.
PRIMES = ((2147483647, 1911520717), (2147483629, 1220703125))
NONE = np.zeros((0, 3), np.int64)
SPACES = b" \t\n\x0b\x0c\r"


class Vocabulary(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def encode(self, data: bytes) -> np.ndarray:
        """Numbers of the words of a text; a long text's words are never held all at once."""
        parts, at = [], 0
        while at < len(data):
            end = at + PIECE
            if end < len(data):
                while end < len(data) and data[end] not in SPACES:
                    end += 1
            parts.append(np.fromiter(map(self.__getitem__, data[at:end].split()), np.int64))
            at = end
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.int64)])


def lyndon_array(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place; ``word`` holds ranks from 0.

    Groups are taken from the greatest to the smallest. When a group is taken, its places are
    final; each has a nearest unfinished place to its left, whose Lyndon word grows by the
    group's own, once for every place that leads to it. Such places leave their group for a new
    one just above it, the higher the more copies were added.
    """
    top = max(word, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(top)]
    for place, rank in enumerate(word):
        members[rank].append(place)
    group = list(word)
    below, above, width = list(range(-1, top - 1)), list(range(1, top + 1)), [1] * top
    left, length = list(range(-1, len(word) - 1)), [1] * len(word)
    now = top - 1
    if top:
        above[now] = -1
    while now >= 0:
        size, places = width[now], [i for i in members[now] if group[i] == now]
        for i in places:
            group[i], length[i] = -1, size
        copies: dict[int, int] = {}
        for i in places:
            j = left[i]
            if j >= 0 and group[j] < 0:
                trail = [i]
                while j >= 0 and group[j] < 0:
                    trail.append(j)
                    j = left[j]
                for k in trail:
                    left[k] = j
            if j >= 0:
                copies[j] = copies.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in copies.items():
            moved.setdefault((group[j], times), []).append(j)
        under, base = -1, -1
        for old, times in sorted(moved):
            if old != base:
                under = base = old
            new = len(width)
            width.append(width[old] + times * size)
            members.append(moved[old, times])
            for j in moved[old, times]:
                group[j] = new
            over = above[under]
            below.append(under)
            above.append(over)
            above[under] = new
            below[over] = new  # the group being taken is above all others, so there is one
            under = new
        now = below[now]
    return length


def stretches(ids: np.ndarray, owner: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch number of each) of the words that may lie in a run.

    Keeps words of passages of ``shared`` words that occur again within their stretch (at first, their
    text), and repeats that within the stretches so found while they shrink. Equal passages have
    equal hashes, so none is lost; passages with the same hash by chance are kept.
    """
    at = np.arange(len(ids))
    while len(at) >= shared:
        n = len(at) - shared + 1
        whole = np.flatnonzero(owner[:n] == owner[shared - 1:])
        hashes = ids[at].astype(np.uint64)
        passage = hashes[whole]
        for step in range(1, shared):
            passage = passage * BASE + hashes[whole + step]
        passage = mix(mix(passage) + owner[whole].astype(np.uint64) * BASE)
        order = np.argsort(passage)
        same = passage[order[1:]] == passage[order[:-1]]
        again = np.zeros(len(whole), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        begin = whole[again]
        edge = np.bincount(begin, minlength=len(at) + 1) - np.bincount(begin + shared, minlength=len(at) + 1)
        keep = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        before = len(at)
        at, owner = at[keep], owner[keep]
        if not len(at):
            break
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        owner = np.cumsum(new) - 1
        if len(at) > 0.9 * before:
            return at, owner
    return at[:0], owner[:0]


class Fingerprints:
    """Whether passages of a sequence are equal, by prefix sums modulo two primes."""

    def __init__(self, ids: np.ndarray):
        self.tables = []
        for prime, base in PRIMES:
            power = np.ones(len(ids) + 1, np.uint64)
            done, step = 1, base
            while done < len(power):
                power[done:2 * done] = power[:min(done, len(power) - done)] * np.uint64(step) % np.uint64(prime)
                done, step = 2 * done, step * step % prime
            sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum((ids.astype(np.uint64) + np.uint64(1)) % np.uint64(prime) * power[:-1] % np.uint64(prime), out=sums[1:])
            self.tables.append((np.uint64(prime), power, sums % np.uint64(prime)))

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Words [i, i + n) against [j, j + n), with j behind i."""
        out = np.ones(len(i), bool)
        for prime, power, sums in self.tables:
            first = (sums[i + n] + prime - sums[i]) % prime * power[j - i] % prime
            out &= first == (sums[j + n] + prime - sums[j]) % prime
        return out

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Longest common extension of places i and j, ``most`` at most; to the left if ``back``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            shift = half if back else 0
            same = self.equal(i - shift, j - shift, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low


def runs_of(ids: np.ndarray, owner: np.ndarray, shortest: int) -> np.ndarray:
    """Rows (first word, length, smallest period) of all runs of ``shortest`` words at least, in order.

    ``owner`` numbers the texts that ``ids`` holds one after another; no run crosses their bounds.
    """
    at, owner = stretches(ids, owner, max(1, (shortest + 1) // 2))
    if not len(at):
        return NONE
    _, rank = np.unique(ids[at], return_inverse=True)
    cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
    roots = np.empty((2, len(at)), np.int64)
    for first, end in zip(cut[:-1], cut[1:], strict=True):
        _, word = np.unique(rank[first:end], return_inverse=True)
        roots[0, first:end] = lyndon_array(word.tolist())
        roots[1, first:end] = lyndon_array((word.max() - word).tolist())
    place, period = np.tile(np.arange(len(at)), 2), roots.ravel()
    first, end = cut[:-1][owner[place]], cut[1:][owner[place]]
    # a root of a run is followed by the run's next word, or the word before it is met again one period on
    on = (place + period < end) & (rank[place] == rank[np.minimum(place + period, len(at) - 1)])
    on |= (place > first) & (rank[place - 1] == rank[place + period - 1])
    place, period, first, end = place[on], period[on], first[on], end[on]
    prints = Fingerprints(rank)
    ahead = prints.reach(place, place + period, end - place - period)
    behind = prints.reach(place, place + period, place - first, back=True)
    found = np.stack([place - behind, behind + period + ahead, period], axis=1)
    found = found[found[:, 1] >= np.maximum(shortest, 2 * found[:, 2])]
    found = np.unique(found, axis=0)
    order = np.lexsort((found[:, 2], found[:, 0]))
    found = found[order]
    found[:, 0] = at[found[:, 0]]
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for the words of a text that are in no run, or in the first period of every run they are in."""
    edge = np.bincount(runs[:, 0] + runs[:, 2], minlength=n + 1) - np.bincount(runs[:, 0] + runs[:, 1], minlength=n + 1)
    return np.cumsum(edge[:-1]) == 0


def repeat_tail(ids: np.ndarray, key: int) -> np.ndarray:
    """The words from place ``key % n`` on replaced by copies of a period that ``key`` fixes."""
    if not len(ids):
        return ids
    a = key % len(ids)
    period = 1 + (len(ids) - a) // (3 + key % 8)
    return np.concatenate((ids[:a], ids[a + np.arange(len(ids) - a) % period]))


def _texts(texts: pa.Array, change: Callable[[int, np.ndarray], np.ndarray], shortest: int
           ) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(words by number, word numbers, runs) of every text, short texts taken together."""
    at = 0
    while at < len(texts):
        vocabulary, parts, size = Vocabulary(), [], 0
        while at < len(texts) and (not parts or size < PIECE):
            data = texts[at].as_py().encode()
            parts.append(change(at, vocabulary.encode(data)))
            size, at = size + len(data), at + 1
        ends = np.cumsum([len(p) for p in parts])
        runs = runs_of(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), shortest)
        bounds = np.searchsorted(runs[:, 0], np.concatenate(([0], ends)))
        by_number = list(vocabulary)
        for k, ids in enumerate(parts):
            own = runs[bounds[k]:bounds[k + 1]].copy()
            own[:, 0] -= ends[k] - len(ids)
            yield by_number, ids, own


def _joined(by_number: list[bytes], ids: np.ndarray) -> Iterator[bytes]:
    """The words joined by one space, in slices."""
    step = PIECE // 8
    for first in range(0, len(ids), step):
        yield (b" " if first else b"") + b" ".join(map(by_number.__getitem__, ids[first:first + step].tolist()))


def _same(_: int, ids: np.ndarray) -> np.ndarray:
    return ids


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 12) -> DataFrame:
    """One row a run: the document's id, ``start`` (word number), ``length``, ``period`` (its smallest).

    A run is a stretch of words that repeats with its period, at least twice and for ``shortest`` words at
    least, and that no neighbouring word extends. Words are cut at ASCII white space. Null and
    empty texts have none; repeated rows each give their own; an empty table gives no rows.
    A narrow map: no shuffle, and memory for one batch, or one long text's word numbers.
    """
    names = {c.lower() for c in ("start", "length", "period")}
    if id_col.lower() in names:
        raise ValueError(f"the id column {id_col} has the name of a result column")
    schema = StructType([docs.schema[id_col], *(StructField(n, LongType()) for n in ("start", "length", "period"))])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("")
            rows, found = [], []
            for row, (_, _, own) in enumerate(_texts(texts, _same, shortest)):
                if len(own):
                    rows.append(np.full(len(own), row))
                    found.append(own)
            if rows:
                found = np.concatenate(found)
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[:, k]) for k in range(3))], names=schema.names)

    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, schema)


def collapsed(docs: DataFrame, text_col: str = "text", shortest: int = 12, to: str = "collapsed") -> DataFrame:
    """The rows with one more column ``to``: the text with each run cut to its first period.

    Words are joined by one space. A word goes if any run holds it behind that run's first period.
    """
    if to.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {to} already")

    def make():
        def cut(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([b"".join(_joined(by_number, ids[kept_words(len(ids), own)])).decode()
                              for by_number, ids, own in _texts(texts, _same, shortest)], pa.string())]
        return cut
    return append_columns(docs, text_col, [StructField(to, StringType())], make)


RESULT = [StructField("n_runs", LongType()), StructField("start", LongType()), StructField("length", LongType()),
          StructField("period", LongType()), StructField("exponent_milli", LongType()),
          StructField("runs_sha256", StringType()), StructField("collapsed_sha256", StringType())]


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 12,
                every: int = 10) -> DataFrame:
    """One row a document: its number of runs, its longest run (ties: first start, smallest period) and digests.

    Documents whose crc32(id) is divisible by ``every`` are read with a repeated tail (``repeat_tail``), the
    others as they are; a null id is read as it is. Null texts hold no words. A document without runs
    has nulls for the longest run and the digest of no bytes for its runs.
    """
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *RESULT])

    def run(batches):
        for batch in batches:
            keys = [None if k is None else zlib.crc32(k.encode()) for k in batch.column(1).to_pylist()]

            def change(row: int, ids: np.ndarray, keys: list = keys) -> np.ndarray:
                key = keys[row]
                return ids if key is None or key % every else repeat_tail(ids, key // every)

            rows = []
            for by_number, ids, own in _texts(batch.column(2).fill_null(""), change, shortest):
                listing = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own.tolist()).encode()).hexdigest()
                text = hashlib.sha256()
                for part in _joined(by_number, ids[kept_words(len(ids), own)] if len(own) else ids):
                    text.update(part)
                best = min(own.tolist(), key=lambda r: (-r[1], r[0], r[2])) if len(own) else [None] * 3
                rows.append((len(own), *best, 1000 * best[1] // best[2] if len(own) else None, listing, text.hexdigest()))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string() if f.dataType == StringType() else pa.int64())
                                    for c, f in zip(columns, RESULT, strict=True))], names=schema.names)

    picked = docs.select(docs[id_col], docs[id_col].cast("string").alias("key"), docs[text_col].cast("string").alias("words"))
    return picked.mapInArrow(run, schema)
