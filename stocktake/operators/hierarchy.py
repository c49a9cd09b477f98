"""Parent/child listings: catalogs -> schemas -> tables, endpoints -> indexes.

(S6, S8-S10, F2, F3, F5, J2-J4, L1-L2, P9-P11, A2-A4)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import (CATALOG_SCAN_LIST_KEYS, COUNTER_KEYS, INJECTED_CHILD_FIELD, LEGACY_CATALOG, SCHEMA_KEY,
                            TABLE_KEY, TABLE_TYPE_EXTERNAL, TABLE_TYPE_MANAGED)
from ..functions.joins import checkpoint_once, join_checked, materialize_small
from ..functions.ranking import top_n_per_group
from ..sources.landing import RECORD_COLS, apply_page_rules, cap_pages, parse_pages, unnest


def record_field(name: str, typ: str = "string", rec: str = "rec") -> Column:
    """A top-level field of a record."""
    step = f"$['{name}']" if "'" not in name else f'$["{name}"]'
    return F.try_variant_get(F.col(rec), step, typ)


#: What tells the collection runs of different workspaces and times apart.
RUN = ["workspace", "collected_at"]


def _same_run(left: DataFrame, right: DataFrame, prefix: str) -> Column:
    """Equality of the run columns that ``right`` has (there named with ``prefix``)."""
    cond = F.lit(True)
    for c in RUN:
        if prefix + c in right.columns:
            cond = cond & left[c].eqNullSafe(right[prefix + c])
    return cond


def select_catalogs(catalog_records: DataFrame, allowlist: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Catalog names to scan, with their run (workspace, collected_at).

    With an allowlist: the allowlist entries that exist in the run (duplicates kept), the
    legacy catalog counting as existing when it is asked for. Sorted by name (binary
    order), first ``limit`` of each run when > 0.
    """
    spark = catalog_records.sparkSession
    run = [c for c in RUN if c in catalog_records.columns]
    names = catalog_records.select(record_field("name").alias("catalog"), *run).where(F.col("catalog").isNotNull())
    if allowlist:
        allow = spark.createDataFrame([(a,) for a in allowlist], "catalog string")
        # the allowlist is a parameter, so it is the side to broadcast; names are filtered before their distinct
        known = names.join(F.broadcast(allow), "catalog", "left_semi").distinct()
        if LEGACY_CATALOG in allowlist:
            legacy = catalog_records.select(F.lit(LEGACY_CATALOG).alias("catalog"), *run).distinct()
            if not run:
                legacy = spark.createDataFrame([(LEGACY_CATALOG,)], "catalog string")
            known = known.unionByName(legacy).distinct()
        names = known.join(F.broadcast(allow), "catalog").select("catalog", *run)
    return top_n_per_group(names, run, ["catalog"], limit) if run else (
        names.orderBy("catalog").limit(limit) if limit and limit > 0 else names)


def _catalog_scan_pages(pages: DataFrame, endpoint: str, parents: DataFrame, parent_col: str,
                        parents_written: bool = False) -> DataFrame:
    """Pages of one catalog-scan endpoint whose parent was selected in the same run (one row per selection).

    The selection (one narrow row per catalog or schema) is written to the shared
    checkpoint folder and counted; under the row limit it is broadcast, so the page
    bodies are never shuffled for this join.
    """
    p = pages.where(F.col("endpoint") == endpoint)
    run = [c for c in RUN if c in parents.columns]
    sel, n = materialize_small(parents.select(F.col(parent_col).alias("_sel"), *[F.col(c).alias(f"_sel_{c}") for c in run]),
                               checkpoint=not parents_written)
    on = (p["parent"] == sel["_sel"]) & _same_run(p, sel, "_sel_")
    return join_checked(p, sel, on, small_bytes=n).drop(*[f"_sel_{c}" for c in run])


def select_schemas(pages: DataFrame, catalogs: DataFrame, limit: int = 0,
                   endpoint: str = SCHEMA_KEY) -> DataFrame:
    """Schema records ``{catalog_name, schema_name, full_name}``.

    Listing per catalog, token paging; any failed page empties the catalog (F9);
    names sorted, first ``limit`` per catalog when > 0 (skew-safe top-N).
    """
    p = _catalog_scan_pages(pages, endpoint, catalogs, "catalog")
    p = apply_page_rules(parse_pages(p, CATALOG_SCAN_LIST_KEYS[endpoint], token_only=True), "complete")
    recs = unnest(p)
    out = recs.select(F.col("workspace"), F.col("collected_at"), F.col("parent").alias("catalog_name"),
                      record_field("name").alias("schema_name"))
    out = out.where(F.col("schema_name").isNotNull())
    out = top_n_per_group(out, [*RUN, "catalog_name"], ["schema_name"], limit)
    out = out.withColumn("full_name", F.concat_ws(".", "catalog_name", "schema_name"))
    # one small row per schema, read by the table scan, the counters and the raw table
    return checkpoint_once(out)


def select_tables(pages: DataFrame, schemas: DataFrame, endpoint: str = TABLE_KEY) -> DataFrame:
    """Table records of the selected schemas, with catalog and schema context.

    Token paging; an HTTP failure keeps the earlier pages, a body that does not parse
    as an object drops the whole schema listing.
    """
    # schemas come checkpointed from select_schemas: counting them is enough
    p = _catalog_scan_pages(pages, endpoint, schemas.select("full_name", *[c for c in RUN if c in schemas.columns]),
                            "full_name", parents_written=True)
    kept = apply_page_rules(parse_pages(p, CATALOG_SCAN_LIST_KEYS[endpoint], token_only=True), "prefix",
                            broken=(F.col("status") == 200) & ~F.col("_usable"))
    recs = unnest(kept)
    run = [c for c in RUN if c in schemas.columns]
    sch, n = materialize_small(schemas.select(F.col("full_name").alias("_fn"), F.col("catalog_name").alias("_catalog"),
                                              F.col("schema_name").alias("_schema"),
                                              *[F.col(c).alias(f"_run_{c}") for c in run]).distinct(), checkpoint=False)
    on = (recs["parent"] == sch["_fn"]) & _same_run(recs, sch, "_run_")
    return join_checked(recs, sch, on, small_bytes=n).drop("_fn", *[f"_run_{c}" for c in run])


def count_types(tables: DataFrame, by: list[str | Column] | None = None, type_col: Column | None = None) -> DataFrame:
    """Tables total, MANAGED and EXTERNAL (other types only in the total)."""
    t = type_col if type_col is not None else record_field("table_type")
    aggs = [F.count(F.lit(1)).alias("uc_tables"),
            F.count_if(t == TABLE_TYPE_MANAGED).alias("managed_tables"),
            F.count_if(t == TABLE_TYPE_EXTERNAL).alias("external_tables")]
    return tables.groupBy(*(by or [])).agg(*aggs)


def catalog_scan(catalog_records: DataFrame, pages: DataFrame, allowlist: list[str] | None = None,
                 catalog_limit: int = 0, schema_limit: int = 0, enable: bool = True):
    """The whole scan as one lazy plan: (catalogs, schemas, tables, counters)."""
    spark: SparkSession = pages.sparkSession
    if not enable:
        empty = spark.createDataFrame([], "catalog string")
        counters = spark.createDataFrame([(k, 0) for k in COUNTER_KEYS], "key string, count long")
        return empty, None, None, counters
    cats = select_catalogs(catalog_records, allowlist, catalog_limit)
    schemas = select_schemas(pages, cats, schema_limit)
    tables = select_tables(pages, schemas)
    counters = uc_counters(cats, schemas, tables)
    return cats, schemas, tables, counters


def uc_counters(cats: DataFrame, schemas: DataFrame, tables: DataFrame, by: Column | None = None) -> DataFrame:
    """Long form ``(key, count)``: catalogs, schemas, tables, managed, external.

    ``by`` (over workspace and collected_at) counts per group, in a column ``group``.
    """
    keys = [] if by is None else [by.alias("group")]
    names = [] if by is None else ["group"]
    one = F.count(F.lit(1)).alias("count")
    c = cats.groupBy(*keys).agg(one).select(*names, F.lit("uc_catalogs").alias("key"), "count")
    s = schemas.groupBy(*keys).agg(one).select(*names, F.lit("uc_schemas").alias("key"), "count")
    t = count_types(tables, keys).select(*names, F.expr(
        "stack(3, 'uc_tables', uc_tables, 'managed_tables', managed_tables, 'external_tables', external_tables) AS (key, count)"))
    return c.unionByName(s).unionByName(t).select(*names, "key", F.col("count").cast("long").alias("count"))


def child_listings(parent_records: DataFrame, child_pages: DataFrame, list_key: str, parent_field: str = "name",
                   paginate: bool = True, page_cap: int = 0, inject_as: str = INJECTED_CHILD_FIELD,
                   keep_records: bool = True) -> DataFrame:
    """Parsed pages that count of every named parent's children, with the parent's name.

    Token paging, failure ends a parent's listing (prefix rule); paging off -> first
    page only. A parent listed twice gets its children twice, as a per-parent reader
    would fetch them twice. ``keep_records=False`` keeps the number of records only.
    """
    run = [c for c in RUN if c in parent_records.columns]
    parents = (parent_records.select(record_field(parent_field).alias("_parent_name"), *[F.col(c).alias(f"_run_{c}") for c in run])
               .where(F.col("_parent_name").isNotNull() & (F.col("_parent_name") != "")))
    p = parse_pages(cap_pages(child_pages, int(page_cap if paginate else 1)), list_key, token_only=True,
                    keep_records=None if keep_records else F.lit(False))
    p = apply_page_rules(p, "prefix")
    # one narrow row per named parent: counted, broadcast under the row limit, so the
    # pages are not shuffled for this join
    parents, n = materialize_small(parents)
    on = (p["parent"] == parents["_parent_name"]) & _same_run(p, parents, "_run_")
    return (join_checked(p, parents, on, small_bytes=n).drop(*[f"_run_{c}" for c in run])
            .withColumnRenamed("_parent_name", inject_as))


def child_rows(parent_records: DataFrame, child_pages: DataFrame, list_key: str, parent_field: str = "name",
               paginate: bool = True, page_cap: int = 0, inject_as: str = INJECTED_CHILD_FIELD) -> DataFrame:
    """Child records of every named parent, tagged with the parent's name (``child_listings``)."""
    p = child_listings(parent_records, child_pages, list_key, parent_field, paginate, page_cap, inject_as)
    return child_records(p, inject_as)


def child_records(listings: DataFrame, inject_as: str = INJECTED_CHILD_FIELD) -> DataFrame:
    """The records of ``child_listings``."""
    cols = [c for c in RECORD_COLS if c not in ("pos", "rec")]
    return listings.select(*cols, inject_as, F.posexplode("_records").alias("pos", "rec")).select(*RECORD_COLS, inject_as)


__all__ = ["record_field", "select_catalogs", "select_schemas", "select_tables", "count_types",
           "catalog_scan", "uc_counters", "child_listings", "child_records", "child_rows"]
