"""Per-group ordering that stays parallel when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import checkpoint_once, join_checked, materialize_small

DEFAULT_SALT_BUCKETS = 64


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[str], n: int,
                    salt_buckets: int = DEFAULT_SALT_BUCKETS) -> DataFrame:
    """First ``n`` rows per group by ``order_cols`` (0 = all rows).

    Two rounds: the top ``n`` of each (group, salt) slice, then the top ``n`` of the
    at most ``n * salt_buckets`` survivors per group. A hot group is thus ranked by
    ``salt_buckets`` tasks instead of one.
    """
    if n <= 0:
        return df
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order_cols]), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    first = (df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(w1))
             .where(F.col("_rn") <= n).drop("_rn", "_salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return first.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= n).drop("_rn")


def rank_in_group(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str = "_rank",
                  num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row within its group (``row_number() - 1``).

    Range-partitions by (group, order), so a hot group spans many partitions, and
    numbers rows like a distributed zip-with-index: per-partition counts (one small
    row each) give offsets, the group's first global index is subtracted. The
    ordering must be total within a group.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    s = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    # Reliable checkpoint: fixes partition ids and row ids, and survives executor loss.
    s = checkpoint_once(s)
    s = s.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # At most ``n`` rows (one per partition): bounded, broadcast.
    s = s.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
    s = s.withColumn("_gidx", F.col("_off") + F.col("_local"))
    starts = s.groupBy(*[F.col(c).alias(f"_s_{c}") for c in group_cols]).agg(F.min("_gidx").alias("_start"))
    starts, cnt = materialize_small(starts)
    cond = None
    for c in group_cols:
        e = s[c].eqNullSafe(starts[f"_s_{c}"])
        cond = e if cond is None else cond & e
    j = join_checked(s, starts, cond, small_bytes=cnt)
    return (j.withColumn(out, F.col("_gidx") - F.col("_start"))
             .drop("_pid", "_mid", "_local", "_off", "_gidx", "_start", *[f"_s_{c}" for c in group_cols]))
