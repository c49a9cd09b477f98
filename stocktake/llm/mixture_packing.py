"""Mixture-controlled packing: deficit round-robin over source queues into fixed-length sequences."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from stocktake.llm.common import stored, text_array

#: Words (runs without ASCII white space) and pieces a worker remembers; each store is emptied when full.
REMEMBERED = 800_000
WORD = re.compile(r"[^\t-\r ]+")
# Latin letters whose lower case is one letter of the same set and which need no composition.
LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
LATIN = re.compile(f"[\t-\r -~{LETTERS}]*")
LATIN_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^\\s0-9a-z{LETTERS}]+")
#: The splitting pattern that LATIN_PIECE restates for texts of LATIN in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

TOKENS = StructType([StructField("row", LongType()), StructField("doc_id", LongType()), StructField("source", StringType()),
                     StructField("part", LongType()), StructField("n", LongType()), StructField("upto", LongType()),
                     StructField("ids", BinaryType())])
PIECES = StructType([StructField(n, LongType()) for n in (
    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def encode_whole(text: str, tokenizer) -> bytes:
    return array("H", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class WordEncoder:
    """Ids (16 bits each) of texts, word by word, asking the tokenizer only about unknown pieces.

    Latin texts are lower-cased and split at once. Printable words of other texts go through the
    tokenizer's normaliser, its splitting pattern and its merge model; words with special strings
    or unprintable characters are encoded whole. ``exact`` tells
    whether probes give the ids of whole texts; if not, texts are encoded whole.
    """

    def __init__(self, path: str):
        import regex
        self.tokenizer = t = _tokenizer(path)
        if t.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        steps = json.loads(t.to_str())["pre_tokenizer"]
        pattern = next((x["pattern"]["Regex"] for x in steps.get("pretokenizers", []) if x["type"] == "Split"), None)
        self.split = regex.compile(pattern) if pattern else None
        self.special = regex.compile("|".join(regex.escape(x.content) for x in t.get_added_tokens_decoder().values()) or "(?!)")
        self.alphabet = self._alphabet()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        probes = ["a  b", " It's\tA\nB ", "x<|endoftext|>y z", "é ́a", "ΑΣ ΑΣς", "don 't 12 3 ½²", "\x1c a\x85b c", "", "the!!&&& İx ßÀ", "日本 語。"]
        self.plain = pattern == PATTERN
        self.exact = self.split is not None and all(self.by_word(p) == encode_whole(p, t) for p in probes)

    @staticmethod
    def _alphabet() -> dict[int, str]:
        """The character that stands for each byte, read off the library on characters that hold it."""
        from tokenizers.pre_tokenizers import ByteLevel
        level, out = ByteLevel(add_prefix_space=False, use_regex=False), {}
        for c in [*range(1, 0x800), *range(0x800, 0xD800, 64), *range(0xE000, 0x110000, 4096)]:
            for byte, char in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0], strict=True):
                out[byte] = char
        return out

    def _learn(self, found: list[str]) -> None:
        """Makes every piece of ``found`` known."""
        missing = set(found).difference(self.pieces)
        if missing:
            if len(self.pieces) + len(missing) > REMEMBERED:
                self.pieces.clear()
                missing = set(found)
            tokenize = self.tokenizer.model.tokenize
            for piece in missing:
                seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
                self.pieces[piece] = array("H", [x.id for x in tokenize(seen)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isprintable() or self.special.search(word):
            return encode_whole(word, self.tokenizer)
        found = self.split.findall(self.tokenizer.normalizer.normalize_str(word))
        self._learn(found)
        return b"".join(map(self.pieces.__getitem__, found))

    def latin(self, text: str) -> bytes:
        """A text of LATIN without special strings: all its pieces at once."""
        found = LATIN_PIECE.findall(text.lower())
        self._learn(found)
        return b"".join(map(self.pieces.__getitem__, found))

    def by_word(self, text: str) -> bytes:
        words = WORD.findall(text)
        missing = set(words).difference(self.words)
        if missing:
            if len(self.words) + len(missing) > REMEMBERED:
                self.words.clear()
                missing = set(words)
            for w in missing:
                self.words[w] = self._word(w)
        return b"".join(map(self.words.__getitem__, words))

    def __call__(self, text: str) -> bytes:
        if not self.exact:
            return encode_whole(text, self.tokenizer)
        if self.plain and LATIN.fullmatch(text) and not self.special.search(text):
            return self.latin(text)
        return self.by_word(text)


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
    """Stored (row, doc_id, source, part, n, upto, ids): the ids of every document with ``end_id``,
    and the tokens its source's queue holds in this partition up to its end."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encode, end = _encoder(tokenizer_path), np.asarray([end_id], dtype="<u2").tobytes()
        part, upto = TaskContext.get().partitionId(), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = text_array(batch, "text").to_pylist()
                ids = [encode(t) + end for t in texts]
                n = [len(x) // 2 for x in ids]
                ends = []
                for s, k in zip(batch.column(2).to_pylist(), n, strict=True):
                    upto[s] = upto.get(s, 0) + k
                    ends.append(upto[s])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([part] * len(n), pa.int64()), pa.array(n, pa.int64()),
                     pa.array(ends, pa.int64()), pa.array(ids, pa.binary())], TOKENS.fieldNames())

    return stored(rows.mapInArrow(run, TOKENS), "tokens")


def _running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each one (within ``keys``)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def place(tokens: DataFrame, window_tokens: int, mixture: dict[str, float] | None = None) -> DataFrame:
    """(row, at): where each document starts in the packed token stream.

    Deficit round-robin in closed form. In every round each source's queue gets its share of
    ``window_tokens`` as credit and sends the documents that its credit so far covers, carrying the
    rest; so a document whose queue holds c tokens up to its end goes out in round
    ceil(c / quantum). Queue positions are the partitions' own sums plus what the partitions before
    hold, so deficits carry over windows and partitions alike. ``mixture`` gives target
    proportions by source (others share what is left by size); by default each source's share of
    all tokens, under which all queues run dry together. A null source is a queue of its own.
    """
    queue = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none")).alias("queue")
    t = tokens.select("row", queue, "part", "n", "upto")
    sums = stored(t.groupBy("queue", "part").agg(F.max("upto").alias("held")), "queue-sums")
    totals = sums.groupBy("queue").agg(F.sum("held").alias("total"))
    whole = sums.agg(F.sum("held")).first()[0] or 1
    share = F.col("total") / F.lit(float(whole))
    if mixture:
        fixed = F.create_map(*[F.lit(x) for k, v in mixture.items() for x in ("s" + k, float(v))])[F.col("queue")]
        named = totals.where(F.col("queue").isin(["s" + k for k in mixture])).agg(F.sum("total")).first()[0] or 0
        rest = max(0.0, 1.0 - sum(mixture.values()))
        share = F.coalesce(fixed, F.col("total") / F.lit(float(max(1, whole - named))) * F.lit(max(rest, 1e-6)))
    carried = _running(sums, ["queue"], ["part"], "held", "carried").join(
        totals.select("queue", share.alias("share")), "queue").select("queue", "part", "carried", "share")
    d = t.join(carried, ["queue", "part"])
    end = F.col("carried") + F.col("upto")
    d = d.select("row", "queue", (end - F.col("n")).alias("begin"), "n",
                 F.ceil(end / (F.col("share") * F.lit(float(window_tokens)))).alias("round"))
    d = stored(d, "rounds")
    sent = stored(d.groupBy("round", "queue").agg(F.sum("n").alias("sent"), F.min("begin").alias("first")), "sent")
    # the rounds' offsets in two steps, so that no task orders all of them
    sent = sent.withColumn("block", F.floor(F.col("round") / 256))
    blocks = _running(sent.groupBy("block").agg(F.sum("sent").alias("in_block")), [], ["block"], "in_block", "block_at")
    sent = _running(sent, ["block"], ["round", "queue"], "sent", "round_at").join(blocks.select("block", "block_at"), "block")
    return d.join(sent, ["round", "queue"]).select(
        "row", (F.col("block_at") + F.col("round_at") + F.col("begin") - F.col("first")).alias("at"))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, window_sequences: int = 32, end_id: int = 2,
         mixture: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> DataFrame:
    """All documents packed into sequences of ``length`` tokens; one row a piece.

    Columns: doc_id, start (the document's ids before the piece), length, ids_crc32 (over the
    piece's ids as little-endian 32-bit numbers), doc_tokens (with ``end_id``), sequence_id,
    offset. A document is cut only where a sequence ends, every id lies in one piece, and only
    the last sequence can be short. Null texts are empty (one token, the end); null ids, null
    sources and repeated rows are packed like any row; an empty table gives no pieces.
    """
    tokens = tokenised(docs, tokenizer_path, end_id, id_col, text_col, source_col)
    placed = tokens.select("row", "doc_id", "ids").join(place(tokens, window_sequences * length, mixture), "row")

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
                begin = 0
                while begin < len(wide):
                    sequence, offset = divmod(at + begin, length)
                    take = min(length - offset, len(wide) - begin)
                    out.append((doc_id, begin, take, zlib.crc32(wide[begin:begin + take].tobytes()), len(wide), sequence, offset))
                    begin += take
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], PIECES.fieldNames())

    return placed.select("row", "doc_id", "ids", "at").mapInArrow(cut, PIECES)
