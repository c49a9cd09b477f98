"""Joins whose broadcast side has a checked size, and derived inputs kept in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path

# Bytes a small side may have to be broadcast. Above it the join shuffles and AQE's
# skew-join handling splits hot keys.
BROADCAST_MAX_BYTES = 64 << 20
# What a row of a broadcast hash table takes besides its texts, per column.
_CELL_BYTES = 24
# A reader decodes up to 4096 rows of a row group at a time: where a row is a page of records, row groups of the
# default 128 MB would make gigabytes a task.
ROW_GROUP_BYTES = 16 << 20
# Pages, records and raw tables are JSON or come from it, of a few keys and much alike: Parquet's default codec leaves
# half as much again.
CODEC = "zstd"


def checkpoint_once(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder and read back; ``by`` gives folders of its own to
    each value of these columns, so that filters on them skip the others.

    The plan starts anew at columnar files that every executor sees: later passes read only
    their columns, and a lost executor costs a re-read.
    """
    path = shared_path(df.sparkSession, "derived")
    (df.write.partitionBy(*by) if by else df.write).option("parquet.block.size", ROW_GROUP_BYTES).option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_bytes(df: DataFrame) -> int:
    """Size of a narrow side as a broadcast would hold it (one aggregate; its texts are measured)."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields
             if isinstance(f.dataType, T.StringType)]
    row = F.lit(_CELL_BYTES * len(df.schema.fields)).cast("long")
    for t in texts:
        row = row + t
    return df.agg(F.sum(row)).first()[0] or 0


def materialize_small(df: DataFrame, checkpoint: bool = True) -> tuple[DataFrame, int]:
    """Cut the lineage of a derived (small) side and measure it: (side, bytes).

    ``checkpoint=False`` for sides read from files already written (measured only).
    """
    df = checkpoint_once(df) if checkpoint else df
    return df, side_bytes(df)


def join_checked(big: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner",
                 small_bytes: int | None = None, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``small`` only if its measured size is under ``max_bytes``.

    Without a measured size the join is left to AQE, which converts it to a broadcast
    only when the materialized side is under its threshold.
    """
    if small_bytes is not None and small_bytes <= max_bytes:
        return big.join(F.broadcast(small), on=on, how=how)
    return big.join(small, on=on, how=how)


def spread(scan: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan over at least ``min_partitions`` tasks when it has fewer.

    Only for plans without a shuffle, whose partitions are known without running anything:
    small single-file inputs arrive as one partition, and CPU-heavy per-record work after
    them (parsing, flattening) would then run on one core. Large inputs already have many
    partitions and pass through unchanged (no extra shuffle).
    """
    target = min_partitions or scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(target) if scan.rdd.getNumPartitions() < target else scan
