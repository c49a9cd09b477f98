"""A workspace landing derived from the test tables.

Each table plays one API listing, so the inventory's work grows with the tables:

| table     | endpoint                 | shape                                              |
| --------- | ------------------------ | -------------------------------------------------- |
| orders    | job                      | 100 per page, nested ``settings`` object           |
| lineitem  | cluster                  | 500 per page, keep-list type                       |
| customer  | repo                     | 100 per page                                       |
| part      | registered_model         | 100 per page, keep-list type                       |
| events    | dashboard                | 100 per page, ``props`` as nested object           |
| supplier  | workspace_conf           | one object page per supplier workspace             |
| nation    | group                    | names as scalars, one page per region              |
| nation    | vector_search_endpoint   | one page                                           |
| supplier  | vector_search_index      | children of their nation's endpoint                |
| region    | catalog                  | one page                                           |
| nation    | schema (catalog scan)    | schemas of their region's catalog                  |
| customer  | table (catalog scan)     | tables of their nation's schema, 50 per page       |
| pages     | mounts                   | url as mount path                                  |
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import SCHEMA_KEY, TABLE_KEY
from ..functions.joins import CODEC
from ..functions.parallel import each
from ..session import shared_path
from ..sources.landing import read_pages
from .landing_builders import pack_pages

WORKSPACE_NAME = "ws-main"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_type_of(segment) -> F.Column:
    """Customer segment -> table type of the scanned table it plays."""
    return (F.when(segment == "BUILDING", F.lit("MANAGED"))
            .when(segment == "AUTOMOBILE", F.lit("MANAGED"))
            .when(segment == "MACHINERY", F.lit("EXTERNAL"))
            .when(segment == "FURNITURE", F.lit("VIEW"))
            .otherwise(F.lit("MATERIALIZED_VIEW")))


#: Folder of each session and table folder, and the endpoints that lie there.
_LANDED: dict[tuple, tuple[str, set[str]]] = {}


def landing(spark: SparkSession, sf_dir: str, materialize: bool = True, endpoints: list[str] | None = None) -> DataFrame:
    """The derived landing (of ``endpoints``; all by default); each endpoint is written once per session and table folder,
    then re-read."""
    build = _listings(spark, sf_dir)
    wanted = list(endpoints or build)
    if not materialize:
        out = None
        for endpoint in wanted:
            out = build[endpoint]() if out is None else out.unionByName(build[endpoint]())
        return out
    # Landed once as parquet in the shared folder, partitioned by endpoint like a real landing: later jobs read
    # columnar files and endpoint filters prune whole folders. Each endpoint is a write of its own, so pages are not
    # sorted by endpoint first.
    path, there = _LANDED.setdefault((spark.sparkContext.applicationId, sf_dir), (shared_path(spark, "landing"), set()))

    def land(endpoint: str) -> None:
        # Files of few pages each: parsing JSON takes far longer than reading it, so it needs more tasks than bytes tell.
        build[endpoint]().drop("endpoint").write.mode("overwrite").option("maxRecordsPerFile", 200).option("compression", CODEC).parquet(
            f"{path}/endpoint={endpoint}")
        there.add(endpoint)

    each([e for e in wanted if e not in there], land)
    pages = read_pages(spark, path)
    return pages if endpoints is None else pages.where(F.col("endpoint").isin(wanted))


def _listings(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """The pages of each endpoint, as functions: only what is landed is planned and read."""
    t = lambda n: read_table(spark, sf_dir, n)
    orders, lineitem, customer, part = t("orders"), t("lineitem"), t("customer"), t("part")
    events, supplier, nation, region = t("events"), t("supplier"), t("nation"), t("region")

    jobs = lambda: pack_pages(orders, "job", "jobs", F.floor(F.col("o_orderkey") / 100) + 1,
                      F.struct(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("creator_user_name"),
                               F.col("o_orderdate").cast("string").alias("created_time"),
                               F.struct("o_orderstatus", "o_totalprice", "o_orderpriority").alias("settings")),
                      F.col("o_orderkey"))
    clusters = lambda: pack_pages(lineitem, "cluster", "clusters", F.floor(F.col("l_orderkey") / 125) + 1,
                          F.struct(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
                                   .alias("cluster_id"), F.col("l_quantity").alias("num_workers"),
                                   F.col("l_returnflag").alias("state"), F.col("l_linestatus").alias("cluster_source"),
                                   F.col("l_extendedprice").alias("cluster_cores"),
                                   F.struct(F.col("l_partkey"), F.col("l_suppkey")).alias("spark_conf")),
                          F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                   "l_extendedprice"))
    repos = lambda: pack_pages(customer, "repo", "repos", F.floor(F.col("c_custkey") / 100) + 1,
                       F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"),
                                F.col("c_mktsegment").alias("branch"), F.col("c_acctbal").alias("head_commit_id")),
                       F.col("c_custkey"))
    models = lambda: pack_pages(part, "registered_model", "registered_models", F.floor(F.col("p_partkey") / 100) + 1,
                        F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                                 F.col("p_brand").alias("user_id"), F.col("p_size"), F.col("p_retailprice"),
                                 F.array(F.col("p_type")).alias("tags")),
                        F.col("p_partkey"))
    dashboards = lambda: pack_pages(events, "dashboard", "dashboards", F.floor(F.col("event_id") / 100) + 1,
                            F.struct(F.col("event_id").alias("dashboard_id"), "user_id", "event_type", "value",
                                     F.from_json("props", "k bigint").alias("props")),
                            F.col("event_id"))
    confs = lambda: pack_pages(supplier, "workspace_conf", None, F.lit(1),
                       F.struct(F.col("s_name").alias("workspace_name"), F.col("s_nationkey").alias("region_id"),
                                F.col("s_acctbal").alias("quota")),
                       F.col("s_suppkey"), workspace=F.col("s_name"))
    groups = lambda: pack_pages(nation, "group", "group_names", F.col("n_regionkey") + 1, F.col("n_name"),
                        F.col("n_nationkey"))
    vs_endpoints = lambda: pack_pages(nation, "vector_search_endpoint", "endpoints", F.lit(1),
                              F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")),
                              F.col("n_nationkey"))
    sup_nation = supplier.join(F.broadcast(nation.select("n_nationkey", "n_name")),
                               supplier.s_nationkey == nation.n_nationkey)
    vs_indexes = lambda: pack_pages(sup_nation, "vector_search_index", "vector_indexes", F.floor(F.col("s_suppkey") / 20) + 1,
                            F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").alias("index_id"),
                                     F.col("n_name").alias("endpoint_name")),
                            F.col("s_suppkey"), parent=F.col("n_name"))
    catalogs = lambda: pack_pages(region, "catalog", "catalogs", F.lit(1),
                          F.struct(F.col("r_name").alias("name"), F.lit("MANAGED_CATALOG").alias("catalog_type")),
                          F.col("r_regionkey"))
    nat_reg = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    schemas = lambda: pack_pages(nat_reg, SCHEMA_KEY, "schemas", F.lit(1), F.struct(F.col("n_name").alias("name")),
                         F.col("n_nationkey"), parent=F.col("r_name"))
    cust_nat = (customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
                .join(F.broadcast(region), F.col("n_regionkey") == region.r_regionkey))
    tables = lambda: pack_pages(cust_nat, TABLE_KEY, "tables", F.floor(F.col("c_custkey") / 50) + 1,
                        F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("table_id"),
                                 table_type_of(F.col("c_mktsegment")).alias("table_type"),
                                 F.col("r_name").alias("catalog_name"), F.col("n_name").alias("schema_name"),
                                 F.struct(F.col("c_acctbal").alias("size")).alias("properties")),
                        F.col("c_custkey"), parent=F.concat_ws(".", "r_name", "n_name"))
    return {"job": jobs, "cluster": clusters, "repo": repos, "registered_model": models, "dashboard": dashboards,
            "workspace_conf": confs, "group": groups, "vector_search_endpoint": vs_endpoints,
            "vector_search_index": vs_indexes, "catalog": catalogs, SCHEMA_KEY: schemas, TABLE_KEY: tables}


def mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pg = read_table(spark, sf_dir, "pages")
    return pg.select(F.col("url").alias("path"), F.lit(WORKSPACE_NAME).alias("workspace"),
                     F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("collected_at"))
