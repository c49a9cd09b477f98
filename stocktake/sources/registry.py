"""Endpoint registry as a small DataFrame, with paging resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import ENDPOINTS, KEEP_FIELDS, PAGING_OVERRIDES

REGISTRY_SCHEMA = ("key string, list_key string, builtin_paginate boolean, has_paging_params boolean, "
                   "parent_key string, parent_field string, enabled boolean, max_pages int")
OVERRIDE_SCHEMA = "key string, override boolean"


def registry_rows(prefix: str = "", enabled: dict | None = None, max_pages: dict | None = None) -> list[tuple]:
    enabled = enabled or {}
    max_pages = max_pages or {}
    rows = []
    for key, list_key, pg, has_params, parent, parent_field in ENDPOINTS:
        rows.append((prefix + key, list_key, pg, has_params, prefix + parent if parent else None, parent_field,
                     enabled.get(key), int(max_pages.get(key, 0))))
    return rows


def registry_df(spark: SparkSession, prefix: str = "", enabled: dict | None = None,
                max_pages: dict | None = None) -> DataFrame:
    """The 27 endpoint configurations (bounded size: safe to broadcast)."""
    return spark.createDataFrame(registry_rows(prefix, enabled, max_pages), REGISTRY_SCHEMA)


def overrides_df(spark: SparkSession, prefix: str = "", overrides: dict | None = None) -> DataFrame:
    ov = dict(PAGING_OVERRIDES if overrides is None else overrides)
    return spark.createDataFrame([(prefix + k, v) for k, v in ov.items()], OVERRIDE_SCHEMA)


def resolve_paging(registry: DataFrame, overrides: DataFrame, master: bool = True,
                   global_max_pages: int = 0, prefix: str = "") -> DataFrame:
    """Resolved config of the enabled endpoints.

    paginate: master switch off -> false; else a non-null override; else the built-in
    flag; else whether paging parameters are declared. ``page_cap``: the global cap
    when > 0, else the endpoint's own; 1 when paging is off; 0 means no cap. ``has_token``:
    the endpoint declares a continuation token; without one its pages only follow more-flags.
    """
    r = registry.join(F.broadcast(overrides), "key", "left")
    paginate = F.when(~F.lit(master), F.lit(False)).otherwise(
        F.coalesce(F.col("override"), F.col("builtin_paginate"), F.col("has_paging_params")))
    cap = F.when(F.lit(global_max_pages) > 0, F.lit(global_max_pages)).otherwise(F.col("max_pages"))
    return (r.where(F.coalesce(F.col("enabled"), F.lit(True)))
             .withColumn("paginate", paginate)
             .withColumn("page_cap", F.when(F.col("paginate"), cap).otherwise(F.lit(1)))
             .withColumn("object_mode", F.col("list_key").isNull())
             .withColumnRenamed("has_paging_params", "has_token")
             .withColumn("keep_fields", keep_fields_col(F.col("key"), prefix))
             .select("key", "list_key", "paginate", "page_cap", "object_mode", "has_token", "parent_key", "parent_field",
                     "keep_fields"))


def keep_fields_col(key, prefix: str = ""):
    """Keep-list of an object type as a literal map lookup (NULL: no keep-list)."""
    entries = []
    for k, fields in KEEP_FIELDS.items():
        entries += [F.lit(prefix + k), F.array(*[F.lit(x) for x in fields])]
    return F.element_at(F.create_map(*entries), key)


def resolved_registry(spark: SparkSession, prefix: str = "", master: bool = True, global_max_pages: int = 0,
                      overrides: dict | None = None, enabled: dict | None = None,
                      max_pages: dict | None = None) -> DataFrame:
    reg = registry_df(spark, prefix, enabled, max_pages)
    return resolve_paging(reg, overrides_df(spark, prefix, overrides), master, global_max_pages, prefix)
