"""The full inventory as one set of lazy plans (T3): pages -> raw tables + summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import (INJECTED_CHILD_FIELD, INJECTED_TABLE_FIELDS, MOUNT_FIELD, MOUNTS_KEY,
                            SCHEMA_KEY, TABLE_KEY)
from ..functions.parallel import each
from ..operators.hierarchy import catalog_scan, child_listings, child_records
from ..operators.shape import add_provenance, shape_records
from ..operators.summary import build_summary, ordered_summary
from ..sinks.tables import InventorySink, drop_matching
from ..sources.landing import landed_pages, unnest
from ..sources.registry import keep_fields_col, resolved_registry


@dataclass
class Inventory:
    raw: dict[str, DataFrame] = field(default_factory=dict)   # key -> raw table rows
    counts: DataFrame | None = None                            # (key, count)
    summary: DataFrame | None = None
    listed: DataFrame | None = None                            # pages that count, with their number of records (_n)
    found: dict = field(default_factory=dict)                  # key -> records found by discovery
    scan: tuple = ()                                           # catalogs, schemas, tables of the catalog scan


def rename_single(df: DataFrame, src: str, dst: str = MOUNT_FIELD) -> DataFrame:
    """One listed value per row as ``{dst}``."""
    return df.select(F.col(src).alias(dst), *[c for c in df.columns if c in ("collected_at", "workspace")])


def build_inventory(spark: SparkSession, pages: DataFrame, prefix: str = "", policy: str = "prefix",
                    master_paging: bool = True, global_max_pages: int = 0, overrides: dict | None = None,
                    enabled: dict | None = None, uc_enable: bool = True, allowlist: list[str] | None = None,
                    catalog_limit: int = 0, schema_limit: int = 0, mounts: DataFrame | None = None,
                    mount_col: str = "path", shape: bool = True,
                    names: dict[tuple, dict[str, str]] | None = None) -> Inventory:
    """Everything the scan produces, lazily; discovery jobs run while building.

    ``shape=False`` leaves the raw tables out: counts and the summary then need no discovery,
    only one pass that counts the records of each listing. ``names`` keeps the columns that paths have had.
    """
    reg = resolved_registry(spark, prefix, master_paging, global_max_pages, overrides, enabled)
    reg_rows = reg.select("key", "list_key", "paginate", "page_cap", "parent_key").collect()
    child_cfg = [r for r in reg_rows if r["parent_key"]]
    child_keys = [r["key"] for r in child_cfg]

    cat_key = prefix + "catalog"
    # counts read no records; where nothing is shaped, only the records of parents and catalogs are written
    needed = None if shape else [cat_key, *(c["parent_key"] for c in child_cfg)]
    listings = landed_pages(pages, reg.where(F.col("parent_key").isNull()), policy, needed)
    top = unnest(listings)
    inv = Inventory()
    narrow = ["endpoint", "collected_at", "workspace", "_n"]
    inv.listed = listings.select(*narrow)
    found: dict = {}            # records per endpoint, counted by the discovery pass
    if shape:
        inv.raw.update({g[0]: df for g, df in shape_records(top, keep=True, prefix=prefix, counts_out=found, names=names).items()})

    for c in child_cfg:
        parents = top.where(F.col("endpoint") == c["parent_key"])
        kids = child_listings(parents, pages.where(F.col("endpoint") == c["key"]), c["list_key"],
                              paginate=c["paginate"], page_cap=c["page_cap"], keep_records=shape)
        if shape:
            shaped = shape_records(child_records(kids), keep=True, prefix=prefix, counts_out=found, names=names,
                                   inject={INJECTED_CHILD_FIELD: F.col(INJECTED_CHILD_FIELD)})
            inv.raw.update({g[0]: df for g, df in shaped.items()})
        inv.listed = inv.listed.unionByName(kids.select(*narrow))

    if shape:
        inv.found = {g[0]: n for g, n in found.items()}
        counts = spark.createDataFrame(list(inv.found.items()), "key string, count long")
    else:
        counts = inv.listed.groupBy(F.col("endpoint").alias("key")).agg(F.sum("_n").alias("count")).where("count > 0")

    # Catalog scan: catalogs from the registry listing, schemas and tables from their pages.
    cats, schemas, tables, counters = catalog_scan(top.where(F.col("endpoint") == cat_key),
                                                   pages.where(F.col("endpoint").isin(SCHEMA_KEY, TABLE_KEY)),
                                                   allowlist, catalog_limit, schema_limit, uc_enable)
    if schemas is not None:
        inv.scan = (cats, schemas, tables)
        if shape:
            inv.raw[prefix + SCHEMA_KEY] = add_provenance(
                schemas.select("catalog_name", "schema_name", "full_name", "collected_at", "workspace")
            ).drop("collected_at", "workspace")
            inv.raw.update(shape_tables(tables.withColumn("endpoint", F.lit(prefix + TABLE_KEY)), prefix, names))

    if mounts is not None:
        m = rename_single(mounts, mount_col)
        inv.raw[MOUNTS_KEY] = add_provenance(m).drop("collected_at", "workspace") \
            if "collected_at" in m.columns else m
    inv.counts = (counted_keys(spark, counts, reg_rows).unionByName(mount_count(spark, mounts))
                  .unionByName(counters.select("key", "count")))
    inv.summary = build_summary(inv.counts, prefix, [r["key"] for r in reg_rows])
    return inv


def counted_keys(spark: SparkSession, counts: DataFrame, reg_rows: list) -> DataFrame:
    """``(key, count)`` of every enabled endpoint, 0 when nothing came back; child endpoints only
    when their parent listing had rows, as children are fetched per parent.

    Both sides have one row an endpoint at most: bounded broadcasts.
    """
    keys = spark.createDataFrame([(r["key"], r["parent_key"]) for r in reg_rows], "key string, parent_key string")
    per_key = keys.join(F.broadcast(counts.withColumnRenamed("key", "_k")), F.col("key") == F.col("_k"), "left")
    parent_counts = counts.select(F.col("key").alias("_pk"), F.col("count").alias("_pc"))
    per_key = per_key.join(F.broadcast(parent_counts), F.col("parent_key") == F.col("_pk"), "left")
    return (per_key.where(F.col("parent_key").isNull() | (F.coalesce(F.col("_pc"), F.lit(0)) > 0))
            .select("key", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def mount_count(spark: SparkSession, mounts: DataFrame | None) -> DataFrame:
    """``(key, count)`` of the mounts."""
    if mounts is None:
        return spark.createDataFrame([(MOUNTS_KEY, 0)], "key string, count long")
    return mounts.agg(F.count(F.lit(1)).cast("long").alias("count")).select(F.lit(MOUNTS_KEY).alias("key"), "count")


def shape_tables(tables: DataFrame, prefix: str = "", names: dict | None = None) -> dict[str, DataFrame]:
    """Table records with the keep-list of tables and catalog/schema context injected."""
    shaped = shape_records(tables, keep=keep_fields_col(F.lit(prefix + TABLE_KEY), prefix), prefix=prefix, names=names,
                           inject={INJECTED_TABLE_FIELDS[0]: F.col("_catalog"),
                                   INJECTED_TABLE_FIELDS[1]: F.col("_schema")})
    return {g[0]: df for g, df in shaped.items()}


def run_batch(spark: SparkSession, pages: DataFrame, sink: InventorySink, drop_first: bool = True,
              **options) -> DataFrame:
    """Write every raw table and the summary; return the ordered summary."""
    if drop_first:
        drop_matching(spark, sink.schema, sink.catalog, raw_prefix=sink.raw_prefix)
    inv = build_inventory(spark, pages, names=sink.stored_names(), **options)
    each(inv.raw.items(), lambda table: sink.write_raw(*table, known_nonempty=inv.found.get(table[0], 0) > 0))
    sink.write_summary(inv.summary)
    return ordered_summary(spark.table(sink.table("workspace_scan_summary", raw=False)))


__all__ = ["Inventory", "build_inventory", "counted_keys", "mount_count", "run_batch", "rename_single", "shape_tables"]
