"""Phrase collocations by stripes: each prefix keys a counter of its next words.

A task counts the next words of every prefix it meets and sends one row a prefix, its stripe: the next words
and their counts side by side. Stripes of one prefix are merged elementwise. A merged stripe
holds the counts of the prefix's extensions, its own count as the sum (what is not counted by word,
a piece's end among it, is one further entry), and the largest extension, which tells whether
the prefix is subsumed.

The prefixes are counted in rounds: none, one word, two words, then all longer ones. Part of a frequent
phrase is frequent itself, so a round extends only phrases that may be frequent by the round
before. That is read off a bit table of fixed size, whose false hits cost time but change no count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from stocktake.llm.bits import Mask, mask
from stocktake.llm.common import stored
from stocktake.llm.words import BASE, mix

#: A byte that no UTF-8 text holds marks the ends of pieces.
MARK = b"\xff"
TABLE = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Word numbers below these are marks and words that can't be part of a frequent phrase.
END, OTHER, FIRST = 0, 1, 2
#: Words a task counts before it sends its stripes, and bytes it splits at once.
HELD, PIECE = 3_000_000, 1 << 20
#: A prefix with more than this part of all words is hot; there are fewer than so many. Its stripe is sent in slices.
HOT, SLICES = 10_000, 64
#: A stripe on its way: next words and counts joined by spaces; what is not counted by word has the empty word.
PARTS = StructType([StructField("lang", StringType()), StructField("prefix", StringType()), StructField("slice", IntegerType()),
                    StructField("next", StringType()), StructField("count", StringType())])
STRIPES = StructType([*PARTS.fields[:3], StructField("total", LongType()), StructField("next", ArrayType(StringType())),
                      StructField("count", ArrayType(LongType())), StructField("hash", ArrayType(LongType()))])


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + MARK + word)


def extend(prefix: np.ndarray | np.uint64, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hashes of its first words and of its last."""
    return mix(prefix * BASE + word)


class Words(dict):
    """Numbers of the words of one language, and its texts as numbers."""

    def __init__(self, lang: str):
        super().__init__({MARK: END})
        self.lang = lang.encode()
        self.list, self.parts, self.size = [b"", b""], [], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.list)
        self.list.append(word)
        return number

    def numbered(self, frequent: Mask | None, pad: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(numbers of all words, text of each number, hash of each number); words that the mask lacks share OTHER."""
        hashes = np.array([0, 0] + [word_hash(self.lang, w) for w in self.list[FIRST:]], np.uint64)
        keep = np.ones(len(hashes), bool) if frequent is None else frequent.has(hashes)
        keep[:FIRST] = True
        number = np.where(keep, np.cumsum(keep) - 1, OTHER).astype(np.int32)
        text = pa.array(self.list, pa.binary()).filter(pa.array(keep)).cast(pa.string())
        return number[np.concatenate([*self.parts, np.zeros(pad, np.int32)])], text, hashes[keep]

    def add(self, data: bytes) -> None:
        """The words of a text, after which a piece ends."""
        data, at = data.translate(TABLE), 0
        while at < len(data):
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
            found = data[at:end].replace(MARK, b" \xff ").split()
            self.parts.append(np.fromiter(map(self.__getitem__, found), np.int32))
            self.size, at = self.size + len(found), end
        self.parts.append(np.zeros(1, np.int32))


def _counted(words: Words, known: int, lengths: list[int], frequent: Mask | None, mask: Mask | None, hot: np.ndarray
             ) -> Iterator[pa.RecordBatch]:
    """Stripes of the prefixes of ``lengths`` frequent words whose every ``known`` words the mask has."""
    ids, text, hashes = words.numbered(frequent, max(lengths) + 1)
    size = len(text)
    if lengths == [0]:
        count = np.bincount(ids, minlength=size)[FIRST:]
        next_word = np.arange(FIRST, size)
        yield _rows(words, pa.array([""] * 1), np.zeros(len(count), np.int64), next_word, count, text, hashes, np.ones(1, bool))
        return
    ok = ids >= FIRST
    phrase = hashes[ids]
    for step in range(1, known):
        ok = ok[:-1] & (ids[step:] >= FIRST)
        phrase = extend(phrase[:-1], hashes[ids[step:]])
    if known > 1:
        at = np.flatnonzero(ok)
        ok[at[~mask.has(phrase[at])]] = False
    for k in lengths:
        last = len(ok) - (k - known) - 1
        whole = ok[:last].copy()
        for step in range(1, k - known + 1):
            whole &= ok[step:last + step]
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        gram = ids[at].astype(np.int64)
        for step in range(1, k):
            if step > 1:
                _, gram = np.unique(gram, return_inverse=True)
            gram = gram * size + ids[at + step]
        _, first, gram = np.unique(gram, return_index=True, return_inverse=True)
        follows = np.where(ok[at + k - known + 1], ids[at + k], OTHER)
        entry, count = np.unique(gram * size + follows, return_counts=True)
        first = at[first]
        prefix = text.take(pa.array(ids[first]))
        for step in range(1, k):
            prefix = pc.binary_join_element_wise(prefix, text.take(pa.array(ids[first + step])), " ")
        yield _rows(words, prefix, entry // size, entry % size, count, text, hashes, np.isin(phrase[first], hot))


def _rows(words: Words, prefix: pa.Array, owner: np.ndarray, next_word: np.ndarray, count: np.ndarray, text: pa.Array,
          hashes: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Counts by (prefix, next word), in order of the prefix, as stripes; those of hot prefixes sliced by the next word."""
    part = np.where(hot[owner] if len(owner) else np.zeros(0, bool), (hashes[next_word] % np.uint64(SLICES)).astype(np.int64), 0)
    key = owner * SLICES + part
    if hot.any():
        order = np.argsort(key, kind="stable")
        key, next_word, count = key[order], next_word[order], count[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(cut, len(key)).astype(np.int32))
    follows = pa.ListArray.from_arrays(offsets, text.take(pa.array(next_word)))
    counts = pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int64)).cast(pa.string()))
    return pa.RecordBatch.from_arrays([
        pa.array([words.lang.decode()] * len(cut), pa.string()), prefix.take(pa.array(key[cut] // SLICES)),
        pa.array((key[cut] % SLICES).astype(np.int32)), pc.binary_join(follows, " "), pc.binary_join(counts, " ")], names=PARTS.names)


def _count(texts: DataFrame, known: int, lengths: list[int], frequent, phrases, hot: np.ndarray) -> DataFrame:
    """Partial stripes, one row a prefix and slice for each run of HELD words of a task."""
    def run(batches):
        single = frequent.value if frequent is not None else None
        bits = phrases.value if phrases is not None else None
        of: dict[str, Words] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    of.setdefault(lang, Words(lang)).add(text.as_py().encode())
                if sum(w.size for w in of.values()) >= HELD:
                    for words in of.values():
                        yield from _counted(words, known, lengths, single, bits, hot)
                    of = {}
        for words in of.values():
            yield from _counted(words, known, lengths, single, bits, hot)
    return texts.mapInArrow(run, PARTS)


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Partial stripes in order of their key -> one stripe a key, with the entries of ``least`` occurrences or more.

    Only the last key's merged entries are carried from batch to batch.
    """
    held: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k) for k in range(3)]
        new = np.zeros(batch.num_rows, bool)
        for column in keys:
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        run = np.cumsum(new)
        nexts, counts = pc.split_pattern(batch.column(3), " "), pc.split_pattern(batch.column(4), " ")
        owner = np.repeat(run, pc.list_value_length(nexts).to_numpy(zero_copy_only=False))
        first = np.flatnonzero(np.append(True, new[1:]))
        labels = [c.take(pa.array(first)).to_pylist() for c in keys]
        nexts, counts = nexts.flatten(), counts.flatten().cast(pa.int64())
        if held is not None:
            key, old_next, old_count = held
            if key == tuple(x[0] for x in labels):
                owner = np.concatenate((np.zeros(len(old_next), np.int64), owner))
                nexts, counts = pa.concat_arrays([old_next, nexts]), pa.concat_arrays([old_count, counts])
            else:
                yield from _stripes([[x] for x in key], np.zeros(len(old_next), np.int64), old_next, old_count, least)
        sums = pa.table({"owner": owner, "next": nexts, "count": counts}).group_by(["owner", "next"], use_threads=False).aggregate([("count", "sum")])
        sums = sums.sort_by("owner").combine_chunks()
        owner = sums["owner"].to_numpy()
        nexts, counts = (pa.concat_arrays(sums[c].chunks) if sums[c].num_chunks else pa.array([], sums[c].type) for c in ("next", "count_sum"))
        done = int(np.searchsorted(owner, run[-1]))
        held = tuple(x[-1] for x in labels), nexts[done:], counts[done:]
        yield from _stripes([x[:-1] for x in labels], owner[:done], nexts[:done], counts[:done], least)
    if held is not None:
        yield from _stripes([[x] for x in held[0]], np.zeros(len(held[1]), np.int64), held[1], held[2], least)


def _stripes(labels: list[list], owner: np.ndarray, nexts: pa.Array, counts: pa.Array, least: int) -> Iterator[pa.RecordBatch]:
    if not labels[0]:
        return
    size = len(labels[0])
    number = counts.to_numpy()
    total = np.zeros(size, np.int64)
    np.add.at(total, owner, number)
    keep = (number >= least) & pc.not_equal(nexts, "").to_numpy(zero_copy_only=False)
    owner, nexts, counts = owner[keep], nexts.filter(pa.array(keep)), counts.filter(pa.array(keep))
    hashes = np.zeros(len(owner), np.uint64)
    of: dict[int, np.uint64 | None] = {}
    langs = [lang.encode() for lang in labels[0]]
    if len(owner):
        own = np.array([word_hash(langs[i], w.encode()) for i, w in zip(owner.tolist(), nexts.to_pylist(), strict=True)], np.uint64)
        for i in np.unique(owner).tolist():
            h = None
            for w in labels[1][i].split(" ") if labels[1][i] else ():
                x = np.array([word_hash(langs[i], w.encode())], np.uint64)
                h = x if h is None else extend(h, x)
            of[i] = h
        plain = np.array([of[i] is None for i in owner.tolist()])
        before = np.array([0 if of[i] is None else int(of[i][0]) for i in owner.tolist()], np.uint64)
        hashes = np.where(plain, own, extend(before, own))
    offsets = pa.array(np.searchsorted(owner, np.arange(size + 1)).astype(np.int32))
    yield pa.RecordBatch.from_arrays([
        pa.array(labels[0], pa.string()), pa.array(labels[1], pa.string()), pa.array(labels[2], pa.int32()), pa.array(total),
        pa.ListArray.from_arrays(offsets, nexts), pa.ListArray.from_arrays(offsets, counts),
        pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))], names=STRIPES.names)


def stripes(docs: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = 100, most_words: int = 5,
            mask_bits: int = 26) -> DataFrame:
    """Merged stripes (lang, prefix, slice, total, next, count, hash): prefixes of 0 to ``most_words`` - 1 words.

    ``next`` and ``count`` list the extensions with ``least`` occurrences or more; ``total`` sums all that
    follows the prefix, so over the slices it is how often the prefix occurs. Prefixes that occur less
    often than ``least`` may be absent. Words are lower-cased (A-Z) and cut at spaces and tabs within pieces
    between ``.,;:!?`` and line ends. Null groups are ``und``, null texts empty.
    """
    texts = docs.select(F.coalesce(docs[group_col].cast("string"), F.lit("und")), docs[text_col].cast("string"))

    def merge(batches):
        return _merged(batches, least)

    done, frequent, bits, hot = [], None, None, np.zeros(0, np.uint64)
    rounds = [(0, [0]), (1, [1]), (2, [2]), (3, list(range(3, most_words)))]
    for known, lengths in [(m, [k for k in ks if k < most_words]) for m, ks in rounds]:
        if not lengths:
            break
        parts = _count(texts, known, lengths, frequent, bits, hot).repartition("lang", "prefix", "slice")
        table = stored(parts.sortWithinPartitions("lang", "prefix", "slice").mapInArrow(merge, STRIPES), f"stripes{known}")
        done.append(table)
        if not known:
            words = table.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        bits = mask(table.select(F.explode("hash").alias("h")), F.col("h"), mask_bits)
        frequent = frequent or bits
        often = table.select(F.explode(F.arrays_zip("hash", "count")).alias("e")).where(F.col("e.count") * HOT > words)
        hot = often.select("e.hash").toArrow()["hash"].to_numpy().view(np.uint64)
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    return out


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = 100, most_words: int = 5,
                 percent: int = 100, top: int = 2000, mask_bits: int = 26) -> DataFrame:
    """The ``top`` phrases of each group by the ratio of their count to what their parts would give by chance.

    Phrases of 2 to ``most_words`` words that occur ``least`` times or more are cut behind each word; the cut with the
    lowest floor(1000 * a * n / (l * r)) counts (ties: the first). Phrases inside a longer one with at least
    ``percent`` per cent of their occurrences are left out: a phrase one word longer tells, since
    whatever lies between is at least as frequent. Ranks go by score and count, then by the
    phrase's bytes. Sums beyond 38 digits raise. An empty table, or one without frequent phrases, gives no rows.
    """
    merged = stripes(docs, text_col, group_col, least, most_words, mask_bits)
    sums = merged.groupBy("lang", "prefix").agg(F.sum("total").alias("f"), F.max(F.array_max("count")).alias("right"))
    words = sums.where("prefix = ''").select("lang", F.col("f").alias("n"))
    sums = sums.where((F.col("prefix") != "") & (F.col("f") >= least))
    found = merged.where("prefix <> ''").select("lang", "prefix", F.explode(F.arrays_zip("next", "count")).alias("e")).select(
        "lang", F.concat_ws(" ", "prefix", "e.next").alias("phrase"), F.col("e.count").alias("a"))
    found = found.withColumn("w", F.split("phrase", " "))
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("head"),
                       F.expr("array_join(slice(w, cut + 1, size(w)), ' ')").alias("rest"))
    cuts = cuts.join(sums.select("lang", F.col("prefix").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(sums.select("lang", F.col("prefix").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(words, "lang")
    score = F.expr("(cast(1000 * a AS decimal(38, 0)) * cast(n AS decimal(38, 0))) div (cast(l AS decimal(38, 0)) * cast(r AS decimal(38, 0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r", "n")).alias("best"))
    left = found.where("size(w) > 2").select("lang", F.expr("array_join(slice(w, 2, size(w)), ' ')").alias("phrase"), "a")
    longer = left.unionByName(sums.where("right IS NOT NULL").select("lang", F.col("prefix").alias("phrase"), F.col("right").alias("a")))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("best.a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("best.a").desc(), "phrase"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", *(F.col(f"best.{c}").cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))
