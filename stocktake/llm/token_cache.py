"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from stocktake.llm.common import append_columns, stored
from stocktake.session import ensure_checkpoint_dir

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Segments a worker remembers; the memory is emptied when full, which changes no count.
REMEMBERED = 1_000_000
SEGMENT = re.compile(" +[^ ]*")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_spaces(model) -> bool:
    """Whether a text's pieces are those of its segments, each a run of spaces and what follows it.

    True if no piece holds a space mark behind another character (then no merge can cross a
    segment's start) and the model treats spaces and control strings as such a split needs.
    """
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any("▁" in p.lstrip("▁") for p in pieces):
        return False
    probes = ["a  b", " a", "a ", "ﬁ x", " a b", "<s> a</s>", "\t a\n b"]
    known: dict[str, int] = {}
    return all(count_segments([p], model, known) == [len(model.encode(p))] for p in probes)


def count_segments(texts: list[str], model, known: dict[str, int]) -> list[int]:
    """Pieces of each text as the sum over its segments, encoding only segments not yet known.

    The model itself puts one space mark before whatever it encodes, so a segment is encoded
    without its first space; a lone space is one piece.
    """
    cut = [SEGMENT.findall(" " + t) if t else [] for t in texts]
    missing = list({s for segments in cut for s in segments if s not in known})
    if len(known) + len(missing) > REMEMBERED:
        known.clear()
        missing = list({s for segments in cut for s in segments})
    known.update(zip(missing, (1 if s == " " else len(x) for s, x in zip(
        missing, model.encode([s[1:] for s in missing], num_threads=1), strict=True)), strict=True))
    return [sum(map(known.__getitem__, segments)) for segments in cut]


_KNOWN: dict[str, dict[str, int]] = {}


def _counter(path: str, by_segment: bool):
    def make():
        model = _model(path)
        known = _KNOWN.setdefault(path, {})

        def count(texts: pa.Array) -> list[pa.Array]:
            out: list[int] = []
            for at in range(0, len(texts), 256):
                some = texts.slice(at, 256).to_pylist()
                out += count_segments(some, model, known) if by_segment else [
                    len(x) for x in model.encode(some, num_threads=1)]
            return [pa.array(out, pa.int64())]
        return count
    return make


def tokenizer_digest(model_path: str) -> str:
    """Digest of the model file: a new version never meets counts of an old one."""
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class TokenCountCache:
    """A Parquet table of counts in a shared folder, appended to by every run.

    The folder stays the same from run to run: ``path``, or one under the cluster's checkpoint folder. ``normalise`` is applied to the text before the digest and before encoding; the default keeps
    every character (null: empty text), so the counts are the library's own.
    """

    def __init__(self, spark: SparkSession, model_path: str, path: str | None = None, normalise=None):
        self.spark, self.model_path = spark, model_path
        self.path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/token-counts"
        self.normalise = normalise or (lambda text: F.coalesce(text.cast("string"), F.lit("")))
        self.tokenizer = tokenizer_digest(model_path)
        self.by_segment = splits_at_spaces(_model(model_path))

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def counts(self) -> DataFrame:
        """What is stored for this tokenizer; one row a digest even if runs overlapped."""
        cache = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path) if self.exists() else self.spark.createDataFrame([], CACHE_SCHEMA)
        return cache.where(F.col("tokenizer") == self.tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def _digest(self, text: Column) -> Column:
        return F.unhex(F.sha2(self.normalise(text).cast("binary"), 256))

    def count(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
        """One row a document: id, UTF-8 bytes, tokens, and whether they exceed ``limit``.

        Distinct contents without a stored count are encoded once and appended. Digests are looked up first;
        only the texts of missing ones travel, once, to meet their copies, and none if all are stored. A
        content that a third of all rows share is combined on the map side. Null ids and repeated rows are counted like any row; an empty table gives none.
        """
        seen = docs.select(F.col(id_col).alias("doc_id"), self._digest(F.col(text_col)).alias("digest"),
                           F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_bytes"))
        texts = docs.select(self._digest(F.col(text_col)).alias("digest"), self.normalise(F.col(text_col)).alias("text"))
        if self.exists():
            missing = stored(seen.select("digest").distinct().join(self.counts(), "digest", "left_anti"), "missing-digests")
            if missing.isEmpty():
                return self._joined(seen, limit)
            texts = texts.join(missing, "digest", "left_semi")
        misses = texts.groupBy("digest").agg(F.min("text").alias("text"))
        fresh = append_columns(misses, "text", [StructField("n_tokens", LongType())],
                               _counter(self.model_path, self.by_segment), keep=["digest"])
        fresh.select("digest", F.lit(self.tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(self.path)
        return self._joined(seen, limit)

    def _joined(self, seen: DataFrame, limit: int) -> DataFrame:
        out = seen.join(self.counts(), "digest")
        return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
