"""DuckDB SQL equal in result to each registered query (same column names).

Written independently of the Spark code: plain joins, windows and CASE over the
test tables. Wide column lists are generated by rule (positions, dimensions).
"""

from __future__ import annotations

from ..fixed_values import ENDPOINTS, KEEP_FIELDS, SUMMARY_FIXED
from .queries import ALLOWLIST, CATALOG_LIMIT, EMBEDDING_DIM, MAX_LINE_POSITIONS, NESTED_LINE_FIELDS, SCHEMA_LIMIT

_INT_FIELDS = {"l_linenumber"}


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _counts_sql() -> str:
    """``cust_scan`` and ``counts(key, cnt)``: every dataset and counter of the inventory."""
    with_rows = {
        "job": "SELECT COUNT(*) FROM orders",
        "cluster": "SELECT COUNT(*) FROM lineitem",
        "repo": "SELECT COUNT(*) FROM customer",
        "registered_model": "SELECT COUNT(*) FROM part",
        "dashboard": "SELECT COUNT(*) FROM events",
        "workspace_conf": "SELECT COUNT(*) FROM supplier",
        "group": "SELECT COUNT(*) FROM nation",
        "vector_search_endpoint": "SELECT COUNT(*) FROM nation",
        "vector_search_index": "SELECT COUNT(*) FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey",
        "catalog": "SELECT COUNT(*) FROM region",
        "dbfs_mount_points": "SELECT COUNT(*) FROM pages",
        "uc_catalogs": "SELECT COUNT(*) FROM region",
        "uc_schemas": "SELECT COUNT(*) FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
        "uc_tables": "SELECT COUNT(*) FROM cust_scan",
        "managed_tables": "SELECT COUNT(*) FROM cust_scan WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')",
        "external_tables": "SELECT COUNT(*) FROM cust_scan WHERE c_mktsegment = 'MACHINERY'",
    }
    parts = [f"SELECT {_sql_str(k)} AS key, ({q}) AS cnt" for k, q in with_rows.items()]
    for e in ENDPOINTS:
        if e[0] not in with_rows:
            parts.append(f"SELECT {_sql_str(e[0])} AS key, 0 AS cnt")
    return f"""cust_scan AS (
  SELECT c.c_mktsegment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
counts AS ({' UNION ALL '.join(parts)})"""


def _summary_sql() -> str:
    labels = [(k, c, o) for k, (c, o) in SUMMARY_FIXED.items()]
    labels += [(e[0], "Auto", e[0].replace("_", " ").title()) for e in ENDPOINTS]
    values = ", ".join(f"({_sql_str(k)}, {_sql_str(c)}, {_sql_str(o)})" for k, c, o in labels)
    return f"""
WITH {_counts_sql()},
labels(key, category, object) AS (VALUES {values})
SELECT l.category AS "Category", l.object AS "Object", CAST(c.cnt AS BIGINT) AS "Count",
       CASE WHEN l.category IN ('Workspace', 'MLflow') THEN 'N' ELSE 'Y' END AS "To_be_Migrated"
FROM counts c JOIN labels l ON c.key = l.key"""


def _keep_lists_sql() -> str:
    parts = []
    for key, fields in KEEP_FIELDS.items():
        own = [f for f in fields if not f.startswith("_")]
        cells = [(f.strip("_"), "bigint", f"SUM(o_orderkey + {i})", "NULL") for i, f in enumerate(own)]
        cells += [("left_over", "string", "SUM(o_custkey)", "NULL"),
                  ("inside_json", "string", "NULL", """MIN('{"o_orderstatus":"' || o_orderstatus || '"}')""")]
        parts += [f"SELECT '{key}' AS endpoint, '{f}' AS field, '{t}' AS type, COUNT(*) AS n, CAST({total} AS BIGINT) AS total, "
                  f"CAST({text} AS VARCHAR) AS json FROM orders" for f, t, total, text in cells]
    return " UNION ALL ".join(parts)


def _nested_orders_sql() -> str:
    order = ", ".join(NESTED_LINE_FIELDS)
    cols = []
    for i in range(MAX_LINE_POSITIONS):
        for f in NESTED_LINE_FIELDS:
            v = f"CAST({f} AS BIGINT)" if f in _INT_FIELDS else f
            cols.append(f"MAX(CASE WHEN pos = {i} THEN {v} END) AS lines_{i}_{f}")
    return f"""
WITH l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {order}) - 1 AS pos FROM lineitem)
SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice, {', '.join(cols)}
FROM orders o LEFT JOIN l ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_orderkey, o.o_orderstatus, o.o_totalprice"""


def _embedding_sql() -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS embedding_{i}" for i in range(EMBEDDING_DIM))
    return f"SELECT vec_id, CAST(label AS BIGINT) AS label, {cols} FROM embeddings"


def _num(x: str) -> str:
    """JSON text of a double as a variant prints it: integral values without '.0'."""
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


_LINES_JSON = f"""
lj AS (SELECT l_orderkey,
  '[' || string_agg('{{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey
                    || ',"l_quantity":' || {_num("l_quantity")} || ',"l_returnflag":"' || l_returnflag
                    || '","l_suppkey":' || l_suppkey || '}}', ','
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) || ']' AS lines_json
  FROM lineitem GROUP BY l_orderkey)"""

_PAGE_RULES = """
WITH p AS (
  SELECT l_orderkey, l_linenumber AS page_no,
         MAX(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS s500,
         MAX(CASE WHEN l_quantity > 48 AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS html,
         MAX(CASE WHEN l_quantity < 3 THEN 1 ELSE 0 END) AS stop
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
f AS (
  SELECT *, (s500 = 1 OR html = 1) AS bad,
         (s500 = 0 AND html = 0 AND (page_no = MAX(page_no) OVER (PARTITION BY l_orderkey) OR stop = 1)) AS terminal
  FROM p),
b AS (
  SELECT l_orderkey, MIN(CASE WHEN bad THEN page_no END) AS first_bad,
         MIN(CASE WHEN terminal THEN page_no END) AS first_term
  FROM f GROUP BY l_orderkey),
k AS (
  SELECT f.l_orderkey, f.page_no FROM f JOIN b ON f.l_orderkey = b.l_orderkey
  WHERE NOT f.bad AND f.page_no < COALESCE(b.first_bad, 2147483647)
    AND f.page_no <= COALESCE(b.first_term, 2147483647) {extra})
SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity
FROM lineitem l JOIN k ON l.l_orderkey = k.l_orderkey AND l.l_linenumber = k.page_no"""

_CLEAN = ("regexp_replace(regexp_replace(regexp_replace(lower(p_name), "
          "'[.\\[\\] :\\-={}();,\"''\\n\\t]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')")

_CUST_SCAN = """customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey"""

_TABLE_TYPE = """CASE c_mktsegment WHEN 'BUILDING' THEN 'MANAGED' WHEN 'AUTOMOBILE' THEN 'MANAGED'
  WHEN 'MACHINERY' THEN 'EXTERNAL' WHEN 'FURNITURE' THEN 'VIEW' ELSE 'MATERIALIZED_VIEW' END"""

ORACLE = {
    "inventory_summary": _summary_sql(),
    "flatten_props": """
SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events""",
    "flatten_nested_orders": _nested_orders_sql(),
    "flatten_long_leaves": """
SELECT c_custkey, 'c_name' AS path, 'S' AS kind, c_name AS str_value, CAST(NULL AS DOUBLE) AS num_value
  FROM customer WHERE c_name IS NOT NULL
UNION ALL SELECT c_custkey, 'c_nationkey', 'I', NULL, CAST(c_nationkey AS DOUBLE) FROM customer
  WHERE c_nationkey IS NOT NULL
UNION ALL SELECT c_custkey, 'c_acctbal', 'D', NULL, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL
UNION ALL SELECT c_custkey, 'c_mktsegment', 'S', c_mktsegment, NULL FROM customer WHERE c_mktsegment IS NOT NULL""",
    "array_positions": _embedding_sql(),
    "json_keep_list": f"""
WITH {_LINES_JSON}
SELECT o.o_orderkey, o.o_totalprice, CAST(o.o_custkey AS VARCHAR) AS o_custkey, o.o_orderstatus,
       o.o_orderpriority, COALESCE(lj.lines_json, '[]') AS lines_json
FROM orders o LEFT JOIN lj ON lj.l_orderkey = o.o_orderkey""",
    "safe_names": f"""
WITH c AS (SELECT p_partkey, p_name, {_CLEAN} AS c0 FROM part),
c2 AS (SELECT *, CASE WHEN c0 = '' THEN '_blank' ELSE c0 END AS clean FROM c),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY clean ORDER BY p_partkey) - 1 AS rn FROM c2)
SELECT p_partkey, p_name, CASE WHEN rn = 0 THEN clean ELSE clean || '__' || CAST(rn AS VARCHAR) END AS safe_name
FROM r""",
    "page_cap": """
WITH o AS (
  SELECT o_orderkey,
         CASE o_orderstatus WHEN 'F' THEN 'job' WHEN 'O' THEN 'instance_pool' ELSE 'cluster' END AS endpoint,
         CAST(floor(o_orderkey / 1500) + 1 AS INTEGER) AS page_no
  FROM orders)
SELECT o_orderkey, endpoint, page_no FROM o
WHERE endpoint = 'job' OR (endpoint = 'instance_pool' AND page_no <= 1) OR (endpoint = 'cluster' AND page_no <= 3)""",
    "page_prefix": _PAGE_RULES.format(extra=""),
    "page_complete": _PAGE_RULES.format(
        extra="AND (b.first_bad IS NULL OR b.first_bad > COALESCE(b.first_term, 2147483647))"),
    "page_unnest": """
SELECT CAST(floor(o_orderkey / 100) + 1 AS BIGINT) AS page_no,
       CAST(ROW_NUMBER() OVER (PARTITION BY floor(o_orderkey / 100) ORDER BY o_orderkey) - 1 AS BIGINT) AS pos,
       o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice
FROM orders""",
    "page_fallback": "SELECT c_custkey, c_name FROM customer",
    "page_object": "SELECT s_suppkey, s_name, s_acctbal, s_name AS workspace FROM supplier",
    "page_scalars": "SELECT c_name AS group_name, CAST(floor(c_custkey / 100) + 1 AS BIGINT) AS page_no FROM customer",
    "child_rows": """
SELECT o.o_orderkey, o.o_totalprice, c.c_name AS endpoint_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "multi_workspace_scan": """
SELECT n_name AS workspace, COUNT(*) AS uc_tables,
       COUNT(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')) AS managed_tables,
       COUNT(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS external_tables
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "multi_workspace_children": """
SELECT s_suppkey, n_name AS workspace, 'shared' AS endpoint_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "recollected_listing": """
SELECT '2024-01' AS month, COUNT(*) AS records, CAST(SUM(o_orderkey) AS BIGINT) AS sum_orderkey FROM orders WHERE o_orderkey <= 1000
UNION ALL SELECT '2024-02', COUNT(*), CAST(SUM(o_orderkey) AS BIGINT) FROM orders""",
    "hierarchy_counts": f"""
SELECT r.r_name AS catalog, n.n_name AS schema, COUNT(*) AS uc_tables,
       COUNT(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')) AS managed_tables,
       COUNT(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS external_tables
FROM {_CUST_SCAN}
GROUP BY r.r_name, n.n_name""",
    "allowlist_topn": f"""
WITH a(catalog) AS (VALUES {', '.join('(' + _sql_str(x) + ')' for x in ALLOWLIST)}),
names AS (SELECT c_name AS catalog FROM customer UNION ALL SELECT 'hive_metastore')
SELECT catalog FROM a WHERE catalog IN (SELECT catalog FROM names) ORDER BY catalog LIMIT {CATALOG_LIMIT}""",
    "topn_per_group": f"""
SELECT catalog_name, schema_name, catalog_name || '.' || schema_name AS full_name FROM (
  SELECT n.n_name AS catalog_name, c.c_name AS schema_name,
         ROW_NUMBER() OVER (PARTITION BY n.n_name ORDER BY c.c_name) AS rn
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)
WHERE rn <= {SCHEMA_LIMIT}""",
    "type_counts": """
SELECT o_orderpriority, COUNT(*) AS uc_tables, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS managed_tables,
       COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS external_tables
FROM orders GROUP BY o_orderpriority""",
    "merge_counts": """
WITH l AS (SELECT o_orderstatus AS key, COUNT(*) AS cnt FROM orders GROUP BY 1),
r AS (SELECT l_linestatus AS key, COUNT(*) AS cnt FROM lineitem GROUP BY 1)
SELECT COALESCE(r.key, l.key) AS key, CAST(COALESCE(r.cnt, l.cnt) AS BIGINT) AS count
FROM l FULL OUTER JOIN r ON l.key = r.key""",
    "name_patterns": """
SELECT p_partkey, p_name FROM part
WHERE (contains(p_name, 'ring') OR contains(p_name, 'bolt')) AND NOT contains(p_name, 'red')""",
    "grand_totals": f"""
WITH {_counts_sql()}
SELECT COUNT(*) AS object_types, CAST(SUM(cnt) AS BIGINT) AS total_records FROM counts
WHERE key NOT IN ('uc_catalogs', 'managed_tables', 'external_tables') AND NOT (key IN ('uc_schemas', 'uc_tables') AND cnt = 0)""",
    "raw_cluster": """
SELECT l_extendedprice AS cluster_cores, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS cluster_id,
       l_linestatus AS cluster_source, l_quantity AS num_workers,
       '{"l_partkey":' || l_partkey || ',"l_suppkey":' || l_suppkey || '}' AS spark_conf_json,
       l_returnflag AS state, '2024-01-01 00:00:00' AS _collected_at, 'ws-main' AS _workspace
FROM lineitem""",
    "raw_job": f"""
SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_time, o_custkey AS creator_user_name,
       o_orderkey AS job_id,
       '{{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus
         || '","o_totalprice":' || {_num("o_totalprice")} || '}}' AS settings_json,
       '2024-01-01 00:00:00' AS _collected_at, 'ws-main' AS _workspace
FROM orders""",
    "raw_tables": f"""
SELECT r.r_name AS catalog, r.r_name AS catalog_name, c.c_name AS name,
       '{{"size":' || {_num("c.c_acctbal")} || '}}' AS properties_json,
       n.n_name AS schema, n.n_name AS schema_name, c.c_custkey AS table_id, {_TABLE_TYPE} AS table_type,
       '2024-01-01 00:00:00' AS _collected_at, 'ws-main' AS _workspace
FROM {_CUST_SCAN}""",
    "evolve_append": """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority
  FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, NULL, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR), o_totalprice, o_orderpriority FROM orders
  WHERE o_orderstatus = 'P'""",
    "stream_equals_batch": """
SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total_value FROM events GROUP BY event_type""",
    "stream_inventory_summary": _summary_sql(),
    "stream_retype": """
SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS amount, '2024-01' AS month FROM orders
UNION ALL SELECT o_orderkey, o_custkey + 0.5, '2024-02' FROM orders""",
    "nameless_parents": """
SELECT s_suppkey, n_name AS endpoint_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 5 > 1""",
    "keep_lists": _keep_lists_sql(),
    "disabled_endpoints": f"""SELECT * FROM ({_summary_sql()}) WHERE NOT ("Category" = 'Auto' AND "Object" IN ('Job', 'Repo'))""",
    "summary_order": f"""
SELECT row_number() OVER (ORDER BY "Category", "Object") AS place, "Category", "Object" FROM ({_summary_sql()})""",
    "empty_records": "SELECT CAST(NULL AS VARCHAR) AS _empty, 'ws' AS _workspace, o_orderkey FROM orders",
    "stream_callback": """
SELECT 'registered_model' AS key, COUNT(*) AS n, 1 AS workspaces FROM part
UNION ALL SELECT 'vector_search_endpoint', COUNT(*), 1 FROM nation
UNION ALL SELECT 'vector_search_index', COUNT(*), 1 FROM supplier
UNION ALL SELECT 'catalog', COUNT(*), 1 FROM region
UNION ALL SELECT 'schema', COUNT(*), 1 FROM nation
UNION ALL SELECT 'table', COUNT(*), 1 FROM customer""",
    "names_over_runs": """
SELECT o_orderkey, o_custkey AS cust_key, CAST(NULL AS VARCHAR) AS cust_key__1, '2024-01' AS month FROM orders
UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority, '2024-02' FROM orders""",
    "retype_large_ints": """
SELECT o_orderkey, CAST(CAST(9007199254740993 + o_orderkey AS DECIMAL(20, 1)) AS VARCHAR) AS amount, '2024-01' AS month FROM orders
UNION ALL SELECT o_orderkey, CAST(CAST(o_custkey AS DECIMAL(20, 1)) + 0.5 AS VARCHAR), '2024-02' FROM orders""",
    "object_history": """
WITH runs AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, 1 AS run FROM orders WHERE o_orderkey % 7 <> 3
  UNION ALL SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 2 THEN o_totalprice + 1.0 ELSE o_totalprice END, 2
    FROM orders WHERE o_orderkey % 7 <> 1
  UNION ALL SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 IN (2, 4) THEN o_totalprice + 1.0 ELSE o_totalprice END, 3
    FROM orders),
steps AS (SELECT *, run - row_number() OVER (PARTITION BY o_orderkey, o_orderstatus, o_totalprice ORDER BY run) AS island FROM runs)
SELECT o_orderkey, o_orderstatus, o_totalprice, '2024-0' || min(run) || '-01' AS valid_from,
  CASE WHEN max(run) < 3 THEN '2024-0' || (max(run) + 1) || '-01' END AS valid_to, COUNT(*) AS n_runs
FROM steps GROUP BY o_orderkey, o_orderstatus, o_totalprice, island""",
    "snapshot_diff": """
WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
n AS (
  SELECT o_orderkey, o_orderstatus,
         CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN o_totalprice + 1.0
              ELSE o_totalprice END AS o_totalprice, o_orderpriority
  FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
  UNION ALL
  SELECT o_orderkey + 100000000, o_orderstatus, o_totalprice, o_orderpriority FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH')
SELECT COALESCE(n.o_orderkey, o.o_orderkey) AS o_orderkey,
       CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed'
            WHEN o.o_totalprice IS DISTINCT FROM n.o_totalprice OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus
              OR o.o_orderpriority IS DISTINCT FROM n.o_orderpriority THEN 'changed' ELSE 'unchanged' END AS change,
       CASE WHEN o.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL
            THEN concat_ws(',',
                   CASE WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'o_orderstatus' END,
                   CASE WHEN o.o_totalprice IS DISTINCT FROM n.o_totalprice THEN 'o_totalprice' END,
                   CASE WHEN o.o_orderpriority IS DISTINCT FROM n.o_orderpriority THEN 'o_orderpriority' END)
            ELSE '' END AS changed_columns
FROM o FULL OUTER JOIN n ON o.o_orderkey = n.o_orderkey""",
}
ORACLE["stream_raw_tables"] = ORACLE["raw_tables"]
