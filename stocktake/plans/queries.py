"""Registered queries: every operator family run over the test tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame; ``ORACLE`` holds the
equivalent DuckDB SQL over the same tables (same column names). Records are made
from table rows with ``to_json``/``parse_json``, pages with ``pack_pages``; the work
of every query grows with its tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import INJECTED_CHILD_FIELD, KEEP_FIELDS, SCHEMA_KEY
from ..functions.joins import checkpoint_once, spread
from ..functions.names import clean_name, with_suffix
from ..functions.ranking import rank_in_group
from ..operators.flatten import discover, flatten_long, flatten_wide
from ..operators.hierarchy import child_rows, count_types, select_catalogs, select_schemas, select_tables
from ..operators.history import object_history
from ..operators.shape import shape_records
from ..operators.snapshots import snapshot_diff
from ..operators.summary import count_rows, grand_totals, merge_counts, ordered_summary
from ..session import shared_path
from ..sinks.tables import InventorySink, ensure_schema, match_names
from ..sources.landing import apply_page_rules, landed_records, page_flags, unnest
from ..sources.registry import resolved_registry
from ..streaming.inventory import stream_inventory
from ..streaming.stream import stream_raw
from . import scenario
from .batch import build_inventory, run_batch, shape_tables
from .landing_builders import DEFAULT_TS, pack_pages

NESTED_LINE_FIELDS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
MAX_LINE_POSITIONS = 13       # most lines of one order at sf0.01 (oracle columns)
EMBEDDING_DIM = 64


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def landed(pages: DataFrame) -> DataFrame:
    """Derived pages written once to the shared checkpoint folder, like a real landing:
    the page-rule pass and the unnest pass then read files instead of re-deriving."""
    return checkpoint_once(pages)


def as_record(*cols) -> Column:
    """A table row as a JSON record (VARIANT), as an API would return it."""
    return F.parse_json(F.to_json(F.struct(*cols)))


def plain_record(df: DataFrame, *cols) -> Column:
    """``as_record`` without the way over JSON text, for rows of ``df`` in which all values are there (JSON leaves missing
    ones out) and of types that JSON brings back as they are: texts, whole numbers and booleans."""
    row = F.struct(*cols)

    def there(x: Column, t: T.DataType) -> Column | None:
        if isinstance(t, T.StructType):
            found = x.isNotNull()
            for f in t.fields:
                inner = there(x.getField(f.name), f.dataType)
                found = None if found is None or inner is None else found & inner
            return found
        same = isinstance(t, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        return x.isNotNull() if same else None

    whole = there(row, df.select(row.alias("r")).schema["r"].dataType)
    return as_record(*cols) if whole is None else F.when(whole, F.to_variant_object(row)).otherwise(as_record(*cols))


def _wide(df: DataFrame, ids: list[str], keep: Column | None = None, scan: bool = True) -> DataFrame:
    # Records derived by joins and JSON encoding are read by two passes (discovery,
    # projection): computed once into the shared checkpoint folder. ``scan=False`` where a
    # shuffle has already spread them.
    df = checkpoint_once(spread(df) if scan else df)
    plans = discover(df, "rec", keep=keep)
    return flatten_wide(df, "rec", plans.get((), []), ids)


# ---------------------------------------------------------------------------------------
# flattening and projection
# ---------------------------------------------------------------------------------------

def q_flatten_props(spark, d):
    """Events with props as a nested object -> wide typed columns."""
    ev = _t(spark, d, "events")
    recs = ev.select("event_id", as_record("user_id", "event_type", "value",
                                           F.parse_json("props").alias("props")).alias("rec"))
    return _wide(recs, ["event_id"])


def _orders_with_lines(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem")
    lines = (li.groupBy(F.col("l_orderkey").alias("_ok"))
             .agg(F.sort_array(F.collect_list(F.struct(*NESTED_LINE_FIELDS))).alias("lines")))
    o = _t(spark, d, "orders")
    return (o.join(lines, o.o_orderkey == lines._ok, "left")
             .withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType))))


def q_flatten_nested_orders(spark, d):
    """Orders with their lines as an array -> positional columns lines_<i>_<field>."""
    o = _orders_with_lines(spark, d)
    recs = o.select(as_record("o_orderkey", "o_orderstatus", "o_totalprice", "lines").alias("rec"))
    return _wide(recs, [], scan=False)


def q_flatten_long_leaves(spark, d):
    """P1 long form: one row per leaf of every customer record."""
    c = _t(spark, d, "customer")
    recs = c.select("c_custkey", as_record("c_name", "c_nationkey", "c_acctbal", "c_mktsegment").alias("rec"))
    long = flatten_long(checkpoint_once(spread(recs)), "rec", ["c_custkey"])
    return long.select("c_custkey", "path", "kind",
                       F.when(F.col("kind") == "S", F.try_variant_get("value", "$", "string")).alias("str_value"),
                       F.when(F.col("kind").isin("I", "D"), F.try_variant_get("value", "$", "double"))
                        .alias("num_value"))


def q_array_positions(spark, d):
    """P1 arrays: embedding vectors -> embedding_0 .. embedding_63."""
    e = _t(spark, d, "embeddings")
    recs = e.select(as_record("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
                    .alias("rec"))
    return _wide(recs, [])


def q_json_keep_list(spark, d):
    """Keep-list projection; kept scalars typed, others text, nested as JSON."""
    o = _orders_with_lines(spark, d)
    recs = o.select(as_record("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                              "lines").alias("rec"))
    keep = F.array(F.lit("o_orderkey"), F.lit("o_totalprice"))
    return _wide(recs, [], keep=keep, scan=False)


def q_safe_names(spark, d):
    """Part names as column names -> cleaned, repeats numbered (skew-safe ranking)."""
    p = _t(spark, d, "part").select("p_partkey", "p_name").withColumn("clean", clean_name("p_name"))
    ranked = rank_in_group(p, ["clean"], ["p_partkey"], out="repeat_no")
    return ranked.select("p_partkey", "p_name", with_suffix(F.col("clean"), F.col("repeat_no")).alias("safe_name"))


# ---------------------------------------------------------------------------------------
# landed pages: caps, failure rules, unnesting
# ---------------------------------------------------------------------------------------

def _orders_by_status_pages(spark, d) -> DataFrame:
    o = _t(spark, d, "orders")
    endpoint = (F.when(F.col("o_orderstatus") == "F", "job").when(F.col("o_orderstatus") == "O", "instance_pool")
                .otherwise("cluster"))
    o = o.withColumn("_ep", endpoint)
    parts = []
    for ep, lk in (("job", "jobs"), ("instance_pool", "instance_pools"), ("cluster", "clusters")):
        parts.append(pack_pages(o.where(F.col("_ep") == ep), ep, lk, F.floor(F.col("o_orderkey") / 1500) + 1,
                                F.struct("o_orderkey", "o_custkey", "o_totalprice"), F.col("o_orderkey"),
                                parent=F.col("o_custkey")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_page_cap(spark, d):
    """Per-endpoint and paging-off caps through the resolved registry."""
    pages = landed(_orders_by_status_pages(spark, d))
    reg = resolved_registry(spark, max_pages={"cluster": 3})
    recs = landed_records(pages, reg)
    return recs.select(F.try_variant_get("rec", "$.o_orderkey", "bigint").alias("o_orderkey"),
                       "endpoint", "page_no")


def _lineitem_pages(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem")
    return pack_pages(li, "job", "jobs", F.col("l_linenumber"),
                      F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"),
                      F.struct(*NESTED_LINE_FIELDS), parent=F.col("l_orderkey"),
                      status=F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), 500)
                      .otherwise(200),
                      html=(F.col("l_quantity") > 48) & (F.col("l_returnflag") == "A"),
                      end_here=F.col("l_quantity") < 3, by_listing=True)


def _rule_output(spark, d, policy):
    p = page_flags(landed(_lineitem_pages(spark, d)))
    kept = apply_page_rules(p, policy)
    recs = unnest(kept, "jobs")
    return recs.select(*[F.try_variant_get("rec", f"$.{c}", t).alias(c) for c, t in
                         (("l_orderkey", "bigint"), ("l_linenumber", "bigint"), ("l_partkey", "bigint"),
                          ("l_suppkey", "bigint"), ("l_quantity", "double"))])


def q_page_prefix(spark, d):
    """Pages before the first failed page, up to the first page without a token."""
    return _rule_output(spark, d, "prefix")


def q_page_complete(spark, d):
    """a failed page before the end empties the whole listing."""
    return _rule_output(spark, d, "complete")


def q_page_unnest(spark, d):
    """Orders in envelopes of 100 -> one row per order with its page position."""
    o = _t(spark, d, "orders")
    pages = pack_pages(o, "job", "jobs", F.floor(F.col("o_orderkey") / 100) + 1,
                       F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"),
                       F.col("o_orderkey"))
    recs = unnest(page_flags(landed(pages)), "jobs")
    w = _wide(recs.select("page_no", "pos", "rec"), ["page_no", "pos"])
    return w.withColumn("pos", F.col("pos").cast("bigint")).withColumn("page_no", F.col("page_no").cast("bigint"))


def q_page_fallback(spark, d):
    """Unpaged body without the expected key -> first array-valued key's records."""
    c = _t(spark, d, "customer")
    # one unpaged listing per block of 100 customers; the list sits under "items", and later lists, of which one
    # comes first by name, are not read
    pages = pack_pages(c, "pipeline", "items", F.lit(1), F.struct("c_custkey", "c_name"), F.col("c_custkey"),
                       parent=F.floor(F.col("c_custkey") / 100),
                       extra_fields={"count": "1", "errors": '[{"c_custkey":-1,"c_name":"wrong list"}]', "zz_empty": "[]"})
    reg = resolved_registry(spark)
    recs = landed_records(landed(pages), reg)
    return recs.select(F.try_variant_get("rec", "$.c_custkey", "bigint").alias("c_custkey"),
                       F.try_variant_get("rec", "$.c_name", "string").alias("c_name"))


def q_page_object(spark, d):
    """S3: object listings (one body per workspace is the record)."""
    s = _t(spark, d, "supplier")
    pages = pack_pages(s, "workspace_conf", None, F.lit(1), F.struct("s_suppkey", "s_name", "s_acctbal"),
                       F.col("s_suppkey"), workspace=F.col("s_name"))
    recs = landed_records(landed(pages), resolved_registry(spark))
    w = shape_records(recs, keep=True)[("workspace_conf",)]
    return w.select("s_suppkey", "s_name", "s_acctbal", F.col("_workspace").alias("workspace"))


def q_page_scalars(spark, d):
    """Lists of plain names wrapped into {group_name} records."""
    n = _t(spark, d, "customer")
    pages = pack_pages(n, "group", "group_names", F.floor(F.col("c_custkey") / 100) + 1, F.col("c_name"),
                       F.col("c_custkey"))
    recs = landed_records(landed(pages), resolved_registry(spark), wrap={"group": "group_name"})
    return recs.select(F.try_variant_get("rec", "$.group_name", "string").alias("group_name"),
                       F.col("page_no").cast("bigint").alias("page_no"))


# ---------------------------------------------------------------------------------------
# hierarchy and counts
# ---------------------------------------------------------------------------------------

def q_child_rows(spark, d):
    """Orders listed per customer endpoint, tagged with the parent's name."""
    c = _t(spark, d, "customer")
    parents = c.select(as_record(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")).alias("rec"))
    o = _t(spark, d, "orders").join(c.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    kids = pack_pages(o, "vector_search_index", "vector_indexes", F.floor(F.col("o_orderkey") / 500) + 1,
                      F.struct("o_orderkey", "o_totalprice"), F.col("o_orderkey"), parent=F.col("c_name"))
    rows = child_rows(parents, landed(kids), "vector_indexes")
    return rows.select(F.try_variant_get("rec", "$.o_orderkey", "bigint").alias("o_orderkey"),
                       F.try_variant_get("rec", "$.o_totalprice", "double").alias("o_totalprice"),
                       "_endpoint_name").withColumnRenamed("_endpoint_name", "endpoint_name")


def _scan_pages(spark, d) -> tuple[DataFrame, DataFrame]:
    region, nation, customer = _t(spark, d, "region"), _t(spark, d, "nation"), _t(spark, d, "customer")
    cats = pack_pages(region, "catalog", "catalogs", F.lit(1), F.struct(F.col("r_name").alias("name")),
                      F.col("r_regionkey"))
    nat_reg = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    schemas = pack_pages(nat_reg, SCHEMA_KEY, "schemas", F.lit(1), F.struct(F.col("n_name").alias("name")),
                         F.col("n_nationkey"), parent=F.col("r_name"))
    cust = (customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
            .join(F.broadcast(region), F.col("n_regionkey") == region.r_regionkey))
    tables = pack_pages(cust, "table", "tables", F.floor(F.col("c_custkey") / 50) + 1,
                        F.struct(F.col("c_name").alias("name"),
                                 scenario.table_type_of(F.col("c_mktsegment")).alias("table_type")),
                        F.col("c_custkey"), parent=F.concat_ws(".", "r_name", "n_name"))
    return cats, schemas.unionByName(tables)


def q_hierarchy_counts(spark, d):
    """Region -> nation -> customer as catalogs, schemas, tables; counts per schema."""
    cat_pages, scan_pages = _scan_pages(spark, d)
    scan_pages = landed(scan_pages)
    cat_recs = landed_records(cat_pages, resolved_registry(spark))
    cats = select_catalogs(cat_recs)
    schemas = select_schemas(scan_pages, cats)
    tables = select_tables(scan_pages, schemas)
    return count_types(tables, by=["_catalog", "_schema"]).select(
        F.col("_catalog").alias("catalog"), F.col("_schema").alias("schema"),
        *[F.col(c).cast("bigint").alias(c) for c in ("uc_tables", "managed_tables", "external_tables")])


def q_multi_workspace_scan(spark, d):
    """Every nation a workspace with the same catalog and schema names; tables counted per workspace."""
    nation, customer = _t(spark, d, "nation"), _t(spark, d, "customer")
    ws = F.col("n_name")
    cats = pack_pages(nation, "catalog", "catalogs", F.lit(1), F.struct(F.lit("main").alias("name")), F.col("n_nationkey"), workspace=ws)
    schemas = pack_pages(nation, SCHEMA_KEY, "schemas", F.lit(1), F.struct(F.lit("s").alias("name")), F.col("n_nationkey"),
                         parent=F.lit("main"), workspace=ws)
    cust = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    tables = pack_pages(cust, "table", "tables", F.floor(F.col("c_custkey") / 50) + 1,
                        F.struct(F.col("c_name").alias("name"), scenario.table_type_of(F.col("c_mktsegment")).alias("table_type")),
                        F.col("c_custkey"), parent=F.lit("main.s"), workspace=ws)
    scan = landed(schemas.unionByName(tables))
    found = select_schemas(scan, select_catalogs(landed_records(cats, resolved_registry(spark))))
    return count_types(select_tables(scan, found), by=["workspace"]).select(
        "workspace", *[F.col(c).cast("bigint").alias(c) for c in ("uc_tables", "managed_tables", "external_tables")])


def q_multi_workspace_children(spark, d):
    """Suppliers listed under an endpoint whose name all nations' workspaces share."""
    nation, supplier = _t(spark, d, "nation"), _t(spark, d, "supplier")
    parents = nation.select(F.col("n_name").alias("workspace"), F.to_timestamp(F.lit(DEFAULT_TS)).alias("collected_at"),
                            as_record(F.lit("shared").alias("name")).alias("rec"))
    kids = pack_pages(supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey), "vector_search_index",
                      "vector_indexes", F.floor(F.col("s_suppkey") / 20) + 1, F.struct("s_suppkey"), F.col("s_suppkey"),
                      parent=F.lit("shared"), workspace=F.col("n_name"))
    return child_rows(parents, landed(kids), "vector_indexes").select(
        F.try_variant_get("rec", "$.s_suppkey", "bigint").alias("s_suppkey"), "workspace",
        F.col("_endpoint_name").alias("endpoint_name"))


def q_recollected_listing(spark, d):
    """F8: the same listing collected twice, with more pages the second time."""
    o = _t(spark, d, "orders")

    def run(rows, when):
        return pack_pages(rows, "job", "jobs", F.floor(F.col("o_orderkey") / 500) + 1, F.struct("o_orderkey"), F.col("o_orderkey"),
                          collected_at=when)

    pages = landed(run(o.where("o_orderkey <= 1000"), "2024-01-01 00:00:00").unionByName(run(o, "2024-02-01 00:00:00")))
    recs = landed_records(pages, resolved_registry(spark, max_pages={"job": 0}, overrides={"job": True}))
    return recs.groupBy(F.date_format("collected_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.try_variant_get("rec", "$.o_orderkey", "bigint")).alias("sum_orderkey"))


ALLOWLIST = ["Customer#000000003", "Customer#000000001", "Customer#000000022", "Customer#000000001",
             "hive_metastore", "Customer#999999999", "Customer#000000100"]
CATALOG_LIMIT = 4


def q_allowlist_topn(spark, d):
    """Customers as catalogs, allowlist (duplicates kept, legacy name added), first N."""
    c = _t(spark, d, "customer")
    pages = pack_pages(c, "catalog", "catalogs", F.floor(F.col("c_custkey") / 100) + 1,
                       F.struct(F.col("c_name").alias("name")), F.col("c_custkey"))
    recs = landed_records(landed(pages),
                          resolved_registry(spark, max_pages={"catalog": 0}, overrides={"catalog": True}))
    return select_catalogs(recs, ALLOWLIST, CATALOG_LIMIT).select("catalog")


SCHEMA_LIMIT = 3


def q_topn_per_group(spark, d):
    """L2: customers as schemas of their nation's catalog, first 3 names per catalog."""
    nation, customer = _t(spark, d, "nation"), _t(spark, d, "customer")
    cats = nation.select(F.col("n_name").alias("catalog"))
    cn = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    pages = pack_pages(cn, SCHEMA_KEY, "schemas", F.floor(F.col("c_custkey") / 100) + 1,
                       F.struct(F.col("c_name").alias("name")), F.col("c_custkey"), parent=F.col("n_name"))
    return select_schemas(landed(pages), cats, SCHEMA_LIMIT).select("catalog_name", "schema_name", "full_name")


def q_type_counts(spark, d):
    """Orders as tables (F -> MANAGED, O -> EXTERNAL, P -> VIEW), counts per priority."""
    o = _t(spark, d, "orders")
    tt = (F.when(F.col("o_orderstatus") == "F", "MANAGED").when(F.col("o_orderstatus") == "O", "EXTERNAL")
          .otherwise("VIEW"))
    recs = o.select("o_orderpriority", as_record(tt.alias("table_type")).alias("rec"))
    out = count_types(recs, by=["o_orderpriority"])
    return out.select("o_orderpriority", *[F.col(c).cast("bigint").alias(c)
                                           for c in ("uc_tables", "managed_tables", "external_tables")])


def q_merge_counts(spark, d):
    """Two count maps merged, the right one wins on shared keys."""
    left = count_rows(_t(spark, d, "orders"), by="o_orderstatus")
    right = count_rows(_t(spark, d, "lineitem"), by="l_linestatus")
    return merge_counts(left, right)


def q_nameless_parents(spark, d):
    """children are listed for parents with a name only; some nations have none, or an empty one."""
    n, sup = _t(spark, d, "nation"), _t(spark, d, "supplier")
    name = F.when(F.col("n_nationkey") % 5 == 0, F.lit(None)).when(F.col("n_nationkey") % 5 == 1, F.lit("")).otherwise(F.col("n_name"))
    parents = pack_pages(n.select("n_nationkey", name.alias("name")), "vector_search_endpoint", "endpoints", F.lit(1),
                         F.struct("name", "n_nationkey"), F.col("n_nationkey"))
    children = pack_pages(sup.join(n.select("n_nationkey", name.alias("name")), sup.s_nationkey == n.n_nationkey), "vector_search_index",
                          "vector_indexes", F.floor(F.col("s_suppkey") / 20) + 1, F.struct("s_suppkey"), F.col("s_suppkey"), parent=F.col("name"))
    recs = landed_records(landed(parents), resolved_registry(spark))
    kids = child_rows(recs, landed(children), "vector_indexes")
    return kids.select(F.try_variant_get("rec", "$.s_suppkey", "bigint").alias("s_suppkey"), F.col(INJECTED_CHILD_FIELD).alias("endpoint_name"))


def q_keep_lists(spark, d):
    """A record for every order in each of the types with a keep-list; kept scalars keep their type, others turn to text."""
    o = spread(_t(spark, d, "orders"))
    out, parts = None, []
    for key, fields in KEEP_FIELDS.items():
        own = [f for f in fields if not f.startswith("_")]
        parts.append(o.select(F.lit(key).alias("endpoint"), plain_record(
            o, *[(F.col("o_orderkey") + i).alias(f) for i, f in enumerate(own)], F.col("o_custkey").alias("left_over"),
            F.struct("o_orderstatus").alias("inside")).alias("rec")))
    recs = parts[0]
    for p in parts[1:]:
        recs = recs.unionByName(p)
    # the records are made anew in both passes: that takes less time than to write and read them, and no disk
    for (key,), df in sorted(shape_records(recs, keep=True, provenance=False).items()):
        # one pass over the columns as they are: no row is copied for each of its cells
        text = {name: F.col(f"`{name}`").cast("string") for name in df.columns}
        number = {name: F.lit(None).cast("bigint") if name == "inside_json" else F.col(f"`{name}`") if t == "bigint"
                  else text[name].cast("bigint") for name, t in df.dtypes}
        totals = df.agg(F.count(F.lit(1)).alias("_rows"), F.array(*[F.struct(
            F.lit(key).alias("endpoint"), F.lit(name).alias("field"), F.lit(t).alias("type"), F.count(F.col(f"`{name}`")).alias("n"),
            F.sum(number[name]).alias("total"), F.min(text[name] if name == "inside_json" else F.lit(None).cast("string")).alias("json"))
            for name, t in df.dtypes]).alias("_cells"))
        rows = totals.where("_rows > 0").select(F.inline("_cells"))
        out = rows if out is None else out.unionByName(rows)
    return out


def q_name_patterns(spark, d):
    """names containing any include pattern and no exclude pattern."""
    p = _t(spark, d, "part")
    return match_names(p, ["ring", "bolt"], ["red"], col="p_name").select("p_partkey", "p_name")


# ---------------------------------------------------------------------------------------
# whole inventory
# ---------------------------------------------------------------------------------------

def q_inventory_summary(spark, d):
    """Flagship: landing -> records of every listing -> counts -> categorised summary."""
    pages = scenario.landing(spark, d)
    inv = build_inventory(spark, pages, mounts=scenario.mounts(spark, d), shape=False)
    return inv.summary


def q_disabled_endpoints(spark, d):
    """F1/R2: two endpoints switched off are neither read nor counted."""
    inv = build_inventory(spark, scenario.landing(spark, d), mounts=scenario.mounts(spark, d), shape=False,
                          enabled={"job": False, "repo": False, "group": True})
    return inv.summary


def q_summary_order(spark, d):
    """The summary in its order, by category and object."""
    inv = build_inventory(spark, scenario.landing(spark, d), mounts=scenario.mounts(spark, d), shape=False)
    at = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # one row an object type
    return ordered_summary(inv.summary).select(at.cast("bigint").alias("place"), "Category", "Object")


def q_grand_totals(spark, d):
    """A5: object types and records over every dataset of the inventory (children, catalog scan, mounts)."""
    inv = build_inventory(spark, scenario.landing(spark, d), mounts=scenario.mounts(spark, d), shape=False)
    return grand_totals(inv.counts)


def _with_run(raw: DataFrame) -> DataFrame:
    """A raw table with its provenance, the collection time as text."""
    return raw.withColumn("_collected_at", F.date_format("_collected_at", "yyyy-MM-dd HH:mm:ss"))


def q_raw_cluster(spark, d):
    """Raw table of a keep-list type (lineitem as clusters)."""
    pages = scenario.landing(spark, d, endpoints=["cluster"])
    recs = landed_records(pages, resolved_registry(spark))
    return _with_run(shape_records(recs, keep=True)[("cluster",)])


def q_raw_job(spark, d):
    """Raw table of jobs: kept typed fields and the nested settings as JSON text."""
    pages = scenario.landing(spark, d, endpoints=["job"])
    recs = landed_records(pages, resolved_registry(spark))
    return _with_run(shape_records(recs, keep=True)[("job",)])


def q_raw_tables(spark, d):
    """Raw table of the catalog scan: table records with catalog and schema injected."""
    pages = scenario.landing(spark, d, endpoints=["catalog", SCHEMA_KEY, "table"])
    cat_pages = pages.where(F.col("endpoint") == "catalog")
    cats = select_catalogs(landed_records(cat_pages, resolved_registry(spark)))
    scan = pages.where(F.col("endpoint").isin(SCHEMA_KEY, "table"))
    tables = select_tables(scan, select_schemas(scan, cats)).withColumn("endpoint", F.lit("table"))
    return _with_run(shape_tables(tables)["table"])


# ---------------------------------------------------------------------------------------
# sinks, streaming, snapshots
# ---------------------------------------------------------------------------------------

CHECK_SCHEMA = "stocktake_checks"


def q_evolve_append(spark, d):
    """K1/K2/K3: overwrite, then append with a new and a missing column, then a retyped one."""
    ensure_schema(spark, CHECK_SCHEMA)
    sink = InventorySink(spark, CHECK_SCHEMA, raw_mode="append")
    o = _t(spark, d, "orders")
    key = f"orders_evolve_{uuid.uuid4().hex[:12]}"
    first = o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")
    sink.write_raw(key, first, mode="overwrite")
    second = o.where(F.col("o_orderstatus") == "O").select("o_orderkey", "o_totalprice", "o_orderpriority")
    sink.write_raw(key, second, mode="append")
    third = o.where(F.col("o_orderstatus") == "P").select("o_orderkey", F.col("o_custkey").cast("string"),
                                                          "o_totalprice", "o_orderpriority")
    sink.write_raw(key, third, mode="append")
    return spark.table(sink.table(key))


def q_stream_equals_batch(spark, d):
    """Events landed as page files, drained by a stream in micro-batches."""
    ev = _t(spark, d, "events")
    pages = pack_pages(ev, "dashboard", "dashboards", F.floor(F.col("event_id") / 100) + 1,
                       F.struct("event_id", "event_type", "value"), F.col("event_id"),
                       parent=F.floor(F.col("event_id") / 1000).cast("string"))
    land = shared_path(spark, "landing")
    pages.repartition(8, "parent").write.mode("overwrite").json(land)
    schema = f"stocktake_stream_{uuid.uuid4().hex[:12]}"
    ensure_schema(spark, schema)
    sink = InventorySink(spark, schema, raw_mode="append")
    q = stream_raw(spark, land, shared_path(spark, "stream-checkpoint"), sink=sink, max_files_per_trigger=2)
    q.awaitTermination()
    raw = spark.table(sink.table("dashboard"))
    return raw.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                         F.round(F.sum("value"), 2).alias("total_value"))


#: Pages of a landed file, and the files from which on they grow in size instead of number.
PAGES_PER_FILE, PAGE_FILES = 200, 1000


def _page_files(spark, pages: DataFrame, land: str | None = None, per_file: int = PAGES_PER_FILE) -> str:
    """Landed page files whose number grows with the pages; a listing's pages lie in many of them. JSON lines repeat
    every key and quote the bodies once more: they are compressed."""
    land = land or shared_path(spark, "landing")
    pages.repartition("workspace", "endpoint", "parent", "page_no").write.mode("append").option("maxRecordsPerFile", per_file).option(
        "compression", "gzip").json(land)
    return land


def _pages_per_file(landed: DataFrame) -> int:
    """Pages for each file of a stream that takes a fixed number of files a micro-batch: a large landing has larger
    files, or the micro-batches, each with a cost of its own, would grow in number with it (footers tell the pages)."""
    return max(PAGES_PER_FILE, -(-landed.count() // PAGE_FILES))


def _stream_sink(spark) -> InventorySink:
    schema = f"stocktake_stream_{uuid.uuid4().hex[:12]}"
    ensure_schema(spark, schema)
    return InventorySink(spark, schema, raw_mode="append")


def q_stream_inventory_summary(spark, d):
    """The whole landing as a stream, listings and their children spread over micro-batches; the summary."""
    pages = scenario.landing(spark, d)
    land = _page_files(spark, pages, per_file=_pages_per_file(pages))
    summary = stream_inventory(spark, land, shared_path(spark, "stream-checkpoint"), _stream_sink(spark), max_files_per_trigger=16,
                               mounts=scenario.mounts(spark, d))
    return summary.select("Category", "Object", "Count", "To_be_Migrated")


def q_stream_raw_tables(spark, d):
    """The catalog scan's raw tables from a stream."""
    pages = scenario.landing(spark, d, endpoints=["catalog", SCHEMA_KEY, "table"])
    sink = _stream_sink(spark)
    land = _page_files(spark, pages, per_file=_pages_per_file(pages))
    stream_inventory(spark, land, shared_path(spark, "stream-checkpoint"), sink, max_files_per_trigger=2)
    return _with_run(spark.table(sink.table("table"))).drop("_unit")


def q_stream_retype(spark, d):
    """Two drains of one stream; a column is BIGINT in the first run and DOUBLE in the second, no old row is rewritten."""
    o = _t(spark, d, "orders")

    def run(value, when):
        return pack_pages(o, "repo", "repos", F.floor(F.col("o_orderkey") / 100) + 1, F.struct("o_orderkey", value.alias("amount")),
                          F.col("o_orderkey"), collected_at=when)

    sink, checkpoint = _stream_sink(spark), shared_path(spark, "stream-checkpoint")
    land = _page_files(spark, run(F.col("o_custkey"), "2024-01-01 00:00:00"))
    stream_inventory(spark, land, checkpoint, sink)
    _page_files(spark, run(F.col("o_custkey") + F.lit(0.5), "2024-02-01 00:00:00"), land)
    stream_inventory(spark, land, checkpoint, sink)
    raw = spark.table(sink.table("repo"))
    return raw.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "amount", F.date_format("_collected_at", "yyyy-MM").alias("month"))


def q_names_over_runs(spark, d):
    """Two runs whose keys clean to one name; each keeps its column through the whole batch write."""
    o = _t(spark, d, "orders")
    schema = f"stocktake_runs_{uuid.uuid4().hex[:12]}"
    ensure_schema(spark, schema)
    sink = InventorySink(spark, schema, raw_mode="append")
    dotted = F.col("o_custkey").alias("cust.key")
    for when, fields in (("2024-01-01 00:00:00", [dotted]),
                         ("2024-02-01 00:00:00", [dotted, F.col("o_orderpriority").alias("Cust key")])):
        pages = pack_pages(o, "repo", "repos", F.floor(F.col("o_orderkey") / 100) + 1, F.struct("o_orderkey", *fields),
                           F.col("o_orderkey"), collected_at=when)
        run_batch(spark, landed(pages), sink, drop_first=False)
    raw = spark.table(sink.table("repo"))
    return raw.select("o_orderkey", "cust_key", "cust_key__1", F.date_format("_collected_at", "yyyy-MM").alias("month"))


def q_retype_large_ints(spark, d):
    """Whole numbers beyond 2**53 in one run, fractions in the next; no digit is lost."""
    o = _t(spark, d, "orders")

    def run(value, when):
        return pack_pages(o, "repo", "repos", F.floor(F.col("o_orderkey") / 100) + 1, F.struct("o_orderkey", value.alias("amount")),
                          F.col("o_orderkey"), collected_at=when)

    sink, checkpoint = _stream_sink(spark), shared_path(spark, "stream-checkpoint")
    land = _page_files(spark, run(F.lit(2 ** 53 + 1) + F.col("o_orderkey"), "2024-01-01 00:00:00"))
    stream_inventory(spark, land, checkpoint, sink)
    _page_files(spark, run(F.col("o_custkey") + F.lit(0.5), "2024-02-01 00:00:00"), land)
    stream_inventory(spark, land, checkpoint, sink)
    raw = spark.table(sink.table("repo"))
    return raw.select("o_orderkey", F.col("amount").cast("string").alias("amount"), F.date_format("_collected_at", "yyyy-MM").alias("month"))


def q_empty_records(spark, d):
    """A listing of records that hold nothing leaves a table without rows, which later records widen."""
    o = _t(spark, d, "orders")
    sink = _stream_sink(spark)
    listed = lambda rec: o.select(F.lit("repo").alias("endpoint"), F.lit("ws").alias("workspace"), rec.alias("rec"),
                                  F.lit("2024-01-01 00:00:00").cast("timestamp").alias("collected_at"))
    for rec in (F.parse_json(F.lit("{}")), as_record("o_orderkey")):
        sink.write_raw("repo", shape_records(checkpoint_once(listed(rec)), keep=True, names=sink.stored_names())[("repo",)])
    return spark.table(sink.table("repo")).select("_empty", "_workspace", "o_orderkey")


def q_stream_callback(spark, d):
    """A caller's function gets every dataset of every evaluated drain, children and catalog scan included."""
    pages = scenario.landing(spark, d, endpoints=["registered_model", "vector_search_endpoint", "vector_search_index",
                                                  "catalog", SCHEMA_KEY, "table"])
    out = shared_path(spark, "callback")

    def keep(key, df):
        df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_workspace").alias("workspaces")).withColumn("key", F.lit(key)).write.mode("append").parquet(out)

    stream_inventory(spark, _page_files(spark, pages), shared_path(spark, "stream-checkpoint"), _stream_sink(spark), fn=keep)
    return spark.read.schema("n long, workspaces long, key string").parquet(out)


def q_object_history(spark, d):
    """Orders over three appended runs as validity intervals: changed, gone for a run, back again, new."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit("ws").alias("_workspace"))
    schema = f"stocktake_runs_{uuid.uuid4().hex[:12]}"
    ensure_schema(spark, schema)
    sink = InventorySink(spark, schema, raw_mode="append")
    turn, raised = F.col("o_orderkey") % 7, F.col("o_totalprice") + 1.0
    for i, rows in enumerate([o.where(turn != 3), o.where(turn != 1).withColumn("o_totalprice", F.when(turn == 2, raised).otherwise(F.col("o_totalprice"))),
                              o.withColumn("o_totalprice", F.when(turn.isin(2, 4), raised).otherwise(F.col("o_totalprice")))]):
        sink.write_raw("order", rows.withColumn("_collected_at", F.lit(f"2024-0{i + 1}-01 00:00:00").cast("timestamp")), known_nonempty=True)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return object_history(spark.table(sink.table("order")), ["o_orderkey"]).select(
        "o_orderkey", "o_orderstatus", "o_totalprice", day("valid_from"), day("valid_to"), "n_runs")


def q_snapshot_diff(spark, d):
    """Two snapshots of orders compared per key."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    old = o
    removed = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    changed = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")
    new = (o.where(~removed)
           .withColumn("o_totalprice", F.when(changed, F.col("o_totalprice") + 1.0)
                       .otherwise(F.col("o_totalprice"))))
    added = (o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "2-HIGH"))
             .withColumn("o_orderkey", F.col("o_orderkey") + 100000000))
    new = new.unionByName(added)
    diff = snapshot_diff(old, new, ["o_orderkey"])
    return diff.select("o_orderkey", "change", F.array_join("changed_columns", ",").alias("changed_columns"))


QUERIES = {
    "inventory_summary": q_inventory_summary,
    "flatten_props": q_flatten_props,
    "flatten_nested_orders": q_flatten_nested_orders,
    "flatten_long_leaves": q_flatten_long_leaves,
    "array_positions": q_array_positions,
    "json_keep_list": q_json_keep_list,
    "safe_names": q_safe_names,
    "page_cap": q_page_cap,
    "page_prefix": q_page_prefix,
    "page_complete": q_page_complete,
    "page_unnest": q_page_unnest,
    "page_fallback": q_page_fallback,
    "page_object": q_page_object,
    "page_scalars": q_page_scalars,
    "child_rows": q_child_rows,
    "multi_workspace_scan": q_multi_workspace_scan,
    "multi_workspace_children": q_multi_workspace_children,
    "recollected_listing": q_recollected_listing,
    "hierarchy_counts": q_hierarchy_counts,
    "allowlist_topn": q_allowlist_topn,
    "topn_per_group": q_topn_per_group,
    "type_counts": q_type_counts,
    "merge_counts": q_merge_counts,
    "nameless_parents": q_nameless_parents,
    "keep_lists": q_keep_lists,
    "name_patterns": q_name_patterns,
    "disabled_endpoints": q_disabled_endpoints,
    "summary_order": q_summary_order,
    "empty_records": q_empty_records,
    "stream_callback": q_stream_callback,
    "grand_totals": q_grand_totals,
    "raw_cluster": q_raw_cluster,
    "raw_job": q_raw_job,
    "raw_tables": q_raw_tables,
    "evolve_append": q_evolve_append,
    "stream_equals_batch": q_stream_equals_batch,
    "stream_inventory_summary": q_stream_inventory_summary,
    "stream_raw_tables": q_stream_raw_tables,
    "stream_retype": q_stream_retype,
    "names_over_runs": q_names_over_runs,
    "retype_large_ints": q_retype_large_ints,
    "object_history": q_object_history,
    "snapshot_diff": q_snapshot_diff,
}

__all__ = ["QUERIES"]
