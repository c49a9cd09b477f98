"""Collection runs stay apart, and a table write that fails loses nothing."""

import datetime as dt

from pyspark.sql import functions as F

from stocktake.operators.hierarchy import child_rows, select_catalogs, select_schemas, select_tables, uc_counters
from stocktake.sources.landing import apply_page_rules, landed_records, page_flags, unnest
from stocktake.sources.registry import resolved_registry

PAGE = ("workspace string, endpoint string, parent string, page_no int, status int, "
        "collected_at timestamp, body string")
JAN, FEB = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def test_a_later_run_is_a_listing_of_its_own(spark):
    pages = spark.createDataFrame([
        ("w", "job", None, 1, 200, JAN, '{"jobs": [{"id": 1}]}'),
        ("w", "job", None, 1, 200, FEB, '{"jobs": [{"id": 1}], "next_page_token": "t"}'),
        ("w", "job", None, 2, 200, FEB, '{"jobs": [{"id": 2}]}')], PAGE)
    kept = apply_page_rules(page_flags(pages), "prefix")
    assert sorted((r.collected_at, r.page_no) for r in kept.collect()) == [(JAN, 1), (FEB, 1), (FEB, 2)]


def test_workspaces_that_share_names_do_not_multiply(spark):
    rows = []
    for w in ("a", "b"):
        for t in (JAN, FEB):
            rows += [(w, "catalog", None, 1, 200, t, '{"catalogs": [{"name": "main"}]}'),
                     (w, "schema", "main", 1, 200, t, '{"schemas": [{"name": "s"}]}'),
                     (w, "table", "main.s", 1, 200, t, '{"tables": [{"name": "t", "table_type": "MANAGED"}]}'),
                     (w, "vector_search_index", "e", 1, 200, t, '{"vector_indexes": [{"name": "i"}]}')]
    pages = spark.createDataFrame(rows, PAGE)
    cats = select_catalogs(landed_records(pages.where("endpoint = 'catalog'"), resolved_registry(spark)))
    schemas = select_schemas(pages, cats)
    tables = select_tables(pages, schemas)
    counts = {r["key"]: r["count"] for r in uc_counters(cats, schemas, tables).collect()}
    assert counts == {"uc_catalogs": 4, "uc_schemas": 4, "uc_tables": 4, "managed_tables": 4, "external_tables": 0}
    parents = pages.where("endpoint = 'catalog'").select("workspace", "collected_at", F.parse_json(F.lit('{"name": "e"}')).alias("rec"))
    assert child_rows(parents, pages.where("endpoint = 'vector_search_index'"), "vector_indexes").count() == 4


def test_first_list_is_the_first_of_the_body(spark):
    pages = spark.createDataFrame([("w", "x", None, 1, 200, JAN, '{"n": 1, "zfirst": [{"a": 1}], "aerrors": [{"a": 2}]}')], PAGE)
    got = unnest(page_flags(pages, paginate=False), None, False).collect()
    assert [r.rec.toJson() for r in got] == ['{"a":1}']
