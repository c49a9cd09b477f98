"""Pages in any order over several files and drains give what one batch over all of them gives."""

import datetime as dt
import json
import uuid

import pytest

from stocktake.session import shared_path
from stocktake.sinks.tables import InventorySink, ensure_schema
from stocktake.sources.landing import PAGE_SCHEMA
from stocktake.streaming.inventory import stream_inventory
from stocktake.streaming.stream import process_batch


def _page(endpoint, parent, page_no, body, status=200, workspace="w1"):
    return (workspace, endpoint, parent, page_no, status, dt.datetime(2024, 1, 1), json.dumps(body))


def test_listings_and_children_over_drains(spark):
    schema = "si_" + uuid.uuid4().hex[:8]
    ensure_schema(spark, schema)
    sink = InventorySink(spark, schema)
    land, check = shared_path(spark, "land"), shared_path(spark, "check")
    seen = []

    def drain(rows):
        spark.createDataFrame(rows, PAGE_SCHEMA).repartition(len(rows)).write.mode("append").json(land)
        got = stream_inventory(spark, land, check, sink, max_files_per_trigger=1, fn=lambda key, df: seen.append(key))
        return {r["Object"]: r["Count"] for r in got.collect()}

    # the second page and the index come before the first page and the index's endpoint
    first = drain([_page("job", None, 2, {"jobs": [{"job_id": 3}]}),
                   _page("vector_search_index", "e", 1, {"vector_indexes": [{"name": "i"}]}),
                   _page("job", None, 1, {"jobs": [{"job_id": 1}, {"job_id": 2}], "next_page_token": "t"}),
                   _page("job", None, 1, {"jobs": [{"job_id": 9}]}, workspace="w2")])
    assert first["Job"] == 4 and "Vector Search Index" not in first
    second = drain([_page("vector_search_endpoint", None, 1, {"endpoints": [{"name": "e"}]}),
                    _page("repo", None, 1, {"repos": [{"id": 1}]})])
    assert (second["Job"], second["Vector Search Index"], second["Repo"]) == (4, 1, 1)
    assert spark.table(sink.table("job")).count() == 4 and spark.table(sink.table("vector_search_index")).count() == 1
    # a first page that turns out to have failed takes the listing's rows back
    third = drain([_page("repo", None, 1, {}, status=500)])
    assert third["Repo"] == 0 and spark.table(sink.table("repo")).count() == 0 and third["Job"] == 4
    assert {"job", "vector_search_index", "repo"} <= set(seen)


def test_light_path_refuses_children(spark):
    pages = spark.createDataFrame([_page("schema", "c", 1, {"schemas": []})], PAGE_SCHEMA)
    with pytest.raises(ValueError, match="child listings"):
        process_batch(pages, 0, None, lambda key, df: None)
