import json

from pyspark.sql import functions as F

from conftest import pages, records
from stocktake.operators.hierarchy import (child_rows, count_types, select_catalogs, select_schemas,
                                           select_tables)


def cat_recs(spark, names):
    return records(spark, [(i, json.dumps({"name": n})) for i, n in enumerate(names)])


def test_allowlist_and_limit(spark):
    cats = cat_recs(spark, ["b", "a", "c"])
    assert sorted(r[0] for r in select_catalogs(cats).collect()) == ["a", "b", "c"]
    got = [r[0] for r in select_catalogs(cats, ["c", "hive_metastore", "zz", "c"]).orderBy("catalog").collect()]
    assert got == ["c", "c", "hive_metastore"]
    assert [r[0] for r in select_catalogs(cats, limit=2).collect()] == ["a", "b"]
    assert [r[0] for r in select_catalogs(cats, ["a"]).collect()] == ["a"]


def test_schemas_complete_rule_and_top_n(spark):
    p = pages(spark, [("schema", "a", 1, 200, '{"schemas":[{"name":"s2"},{"name":"s1"}],"next_page_token":"t"}'),
                      ("schema", "a", 2, 200, '{"schemas":[{"name":"s3"}]}'),
                      ("schema", "b", 1, 200, '{"schemas":[{"name":"x"}],"next_page_token":"t"}'),
                      ("schema", "b", 2, 500, "{}")])
    cats = spark.createDataFrame([("a",), ("b",)], "catalog string")
    got = sorted((r["catalog_name"], r["schema_name"], r["full_name"]) for r in select_schemas(p, cats).collect())
    assert got == [("a", "s1", "a.s1"), ("a", "s2", "a.s2"), ("a", "s3", "a.s3")]
    top = sorted(r["schema_name"] for r in select_schemas(p, cats, limit=2).collect())
    assert top == ["s1", "s2"]


def test_tables_http_failure_keeps_earlier_pages_broken_body_drops_all(spark):
    schemas = spark.createDataFrame([("a", "s", "a.s"), ("a", "t", "a.t")],
                                    "catalog_name string, schema_name string, full_name string")
    p = pages(spark, [
        ("table", "a.s", 1, 200, '{"tables":[{"name":"t1","table_type":"MANAGED"}],"next_page_token":"x"}'),
        ("table", "a.s", 2, 503, ""),
        ("table", "a.t", 1, 200, '{"tables":[{"name":"u1","table_type":"EXTERNAL"}],"next_page_token":"x"}'),
        ("table", "a.t", 2, 200, "not json")])
    t = select_tables(p, schemas)
    got = [(r["_catalog"], r["_schema"]) for r in t.collect()]
    assert got == [("a", "s")]
    c = count_types(t).first()
    assert (c["uc_tables"], c["managed_tables"], c["external_tables"]) == (1, 1, 0)


def test_child_rows_skip_unnamed_parents(spark):
    parents = records(spark, [(1, '{"name":"e1"}'), (2, '{"name":""}'), (3, '{"id":3}'), (4, '{"name":"e1"}')])
    kids = pages(spark, [("vector_search_index", "e1", 1, 200, '{"vector_indexes":[{"name":"i1"}]}'),
                         ("vector_search_index", "", 1, 200, '{"vector_indexes":[{"name":"i2"}]}')])
    got = [(r["_endpoint_name"], r["rec"].toJson()) for r in child_rows(parents, kids, "vector_indexes").collect()]
    assert got == [("e1", '{"name":"i1"}'), ("e1", '{"name":"i1"}')]


def test_count_types_by_group(spark):
    recs = records(spark, [(1, '{"table_type":"MANAGED"}'), (1, '{"table_type":"VIEW"}'),
                           (2, '{"table_type":"EXTERNAL"}')])
    got = {r["id"]: (r["uc_tables"], r["managed_tables"], r["external_tables"])
           for r in count_types(recs, by=["id"]).collect()}
    assert got == {1: (2, 1, 0), 2: (1, 0, 1)}
    assert F is not None
