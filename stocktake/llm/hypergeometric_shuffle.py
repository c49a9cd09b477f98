"""Uniform sharding with exact shard sizes from a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stocktake.functions.names import quote_ident
from stocktake.llm.common import stored


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement are good (any size; inversion from the mode)."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    u = rng.random() - p
    down = up = mode
    p_down = p_up = p
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(rows_of_part: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard: row sums are the partitions' rows, column
    sums the shards' exact sizes (at most one apart), distributed as under a uniform permutation."""
    total = sum(rows_of_part)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    rng = random.Random(seed)
    out = np.zeros((len(rows_of_part), shards), dtype=np.int64)
    for p, n in enumerate(rows_of_part):
        rest = sum(left)
        for j in range(shards):
            k = hypergeometric(rng, left[j], rest - left[j], n)
            rest -= left[j]
            n -= k
            left[j] -= k
            out[p, j] = k
    return out


def uniform_shards(rows: DataFrame, shards: int = 40, seed: int = 20240229, rows_per_bucket: int = 4096) -> DataFrame:
    """``rows`` dealt to ``shards`` shards of exact size, in uniformly random order.

    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard). Every partition permutes
    its rows locally and cuts them by its row of the communication matrix, the rows are exchanged,
    and each shard is permuted again. ``rows`` should be narrow: the columns travel with it.

    The driver sees one count a partition. The second permutation numbers random buckets of about
    ``rows_per_bucket`` rows and adds the buckets' offsets, so a shard of any size is spread over
    many tasks. Repeated rows are dealt one by one; an empty table gives no rows; null values in
    any column are carried along. Columns named shard or slot are replaced.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    # inside, the columns go by number, so that none clashes with the operator's own
    rows = rows.select(*[F.col(quote_ident(c)).alias(f"c{i}") for i, c in enumerate(names)])
    schema = StructType([*rows.schema.fields, StructField("part__", LongType()), StructField("rank__", LongType())])

    def permute(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = TaskContext.get().partitionId()
        n = sum(b.num_rows for b in held)
        rank = np.random.default_rng([seed, part]).permutation(n)
        at = 0
        for b in held:
            cols = [*b.columns, pa.array(np.full(b.num_rows, part), pa.int64()), pa.array(rank[at:at + b.num_rows], pa.int64())]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    local = stored(rows.mapInArrow(permute, schema), "permuted")
    parts = [(int(r[0]), int(r[1])) for r in local.groupBy("part__").count().orderBy("part__").collect()]
    matrix = communication_matrix([n for _, n in parts], shards, seed)
    cuts = spark.createDataFrame([(p, np.cumsum(matrix[i]).tolist()) for i, (p, _) in enumerate(parts)],
                                 "part__ long, cuts__ array<long>")
    # one row a partition, whose number the scan bounds; AQE broadcasts it only if it is small
    dealt = local.join(cuts, "part__").withColumn(
        "shard", F.expr("cast(size(filter(cuts__, c -> c <= rank__)) as int)"))
    buckets = max(1, -(-sum(n for _, n in parts) // (shards * rows_per_bucket)))
    dealt = dealt.withColumn("key__", F.xxhash64(F.lit(seed), "part__", "rank__"))
    dealt = dealt.withColumn("bucket__", F.pmod(F.shiftrightunsigned("key__", 20), F.lit(buckets)).cast("int"))
    sizes = stored(dealt.groupBy("shard", "bucket__").count(), "bucket-sizes")
    w = Window.partitionBy("shard").orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket__", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before__"))
    w = Window.partitionBy("shard", "bucket__").orderBy("key__", "part__", "rank__")
    out = dealt.withColumn("n__", F.row_number().over(w)).join(offsets, ["shard", "bucket__"])
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "shard", (F.col("n__") - 1 + F.col("before__")).alias("slot"))


def document_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest rows of the sharded documents (law ``rows``); a null text has size 16 and the CRC of nothing."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    out = uniform_shards(narrow, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
