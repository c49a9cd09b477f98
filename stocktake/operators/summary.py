"""Counts and the categorised summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import (AUTO_CATEGORY, COUNTER_KEYS, ENDPOINTS, NOT_MIGRATED_CATEGORIES, OTHER_CATEGORY,
                            SUMMARY_FIXED)
from ..functions.names import display_name

#: Counters that are the sizes of datasets of their own.
SCAN_DATASET_KEYS = ("uc_schemas", "uc_tables")
SUMMARY_SCHEMA = "Category string, Object string, Count bigint, To_be_Migrated string"


def count_rows(records: DataFrame, by: str = "endpoint") -> DataFrame:
    """Rows per dataset as ``(key, count)`` (A1); partial counts per task, tiny shuffle."""
    return records.groupBy(F.col(by).alias("key")).agg(F.count(F.lit(1)).cast("long").alias("count"))


def merge_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two count maps; a key in both takes the right count."""
    l_, r_ = left.alias("l"), right.alias("r")
    return (l_.join(r_, F.col("l.key") == F.col("r.key"), "full_outer")
              .select(F.coalesce(F.col("r.key"), F.col("l.key")).alias("key"),
                      F.coalesce(F.col("r.count"), F.col("l.count")).cast("long").alias("count")))


def grand_totals(counts: DataFrame) -> DataFrame:
    """Number of object types and of records over all datasets of a ``(key, count)`` inventory (A5).

    Datasets are the listed endpoints (empty ones included), the mounts, and the schemas and
    tables of the catalog scan where there are any; counters that only restate part of a
    dataset (catalogs scanned, managed and external tables) are left out.
    """
    scanned = F.col("key").isin(*SCAN_DATASET_KEYS)
    held = counts.where(~F.col("key").isin(*COUNTER_KEYS) | (scanned & (F.col("count") > 0)))
    return held.agg(F.count_distinct("key").cast("long").alias("object_types"),
                    F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_records"))


def label_frames(spark: SparkSession, prefix: str = "", registry_keys: list[str] | None = None):
    """Fixed labels and registry keys as small DataFrames (bounded: broadcast)."""
    fixed = spark.createDataFrame([(k, c, o) for k, (c, o) in SUMMARY_FIXED.items()],
                                  "f_key string, f_category string, f_object string")
    keys = registry_keys if registry_keys is not None else [prefix + e[0] for e in ENDPOINTS]
    auto = spark.createDataFrame([(k,) for k in keys], "a_key string")
    return fixed, auto


def build_summary(counts: DataFrame, prefix: str = "", registry_keys: list[str] | None = None) -> DataFrame:
    """Category, Object, Count, To_be_Migrated for every counted key.

    Fixed labels first, then registry keys ("Auto", display name), else ("Other", key).
    Both label tables have a fixed size, so they are broadcast.
    """
    fixed, auto = label_frames(counts.sparkSession, prefix, registry_keys)
    j = (counts.join(F.broadcast(fixed), F.col("key") == F.col("f_key"), "left")
               .join(F.broadcast(auto), F.col("key") == F.col("a_key"), "left"))
    category = (F.when(F.col("f_key").isNotNull(), F.col("f_category"))
                 .when(F.col("a_key").isNotNull(), F.lit(AUTO_CATEGORY))
                 .otherwise(F.lit(OTHER_CATEGORY)))
    obj = (F.when(F.col("f_key").isNotNull(), F.col("f_object"))
            .when(F.col("a_key").isNotNull(), display_name(F.col("key"), prefix))
            .otherwise(F.col("key")))
    return j.select(category.alias("Category"), obj.alias("Object"),
                    F.col("count").cast("long").alias("Count"),
                    F.when(category.isin(*NOT_MIGRATED_CATEGORIES), F.lit("N")).otherwise(F.lit("Y"))
                     .alias("To_be_Migrated"))


def ordered_summary(summary: DataFrame) -> DataFrame:
    """The documented view: ordered by Category, Object."""
    return summary.orderBy("Category", "Object")
