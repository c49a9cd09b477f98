"""Small helpers: renaming, snapshot slices, prefixed summaries, provenance."""

import datetime as dt

from pyspark.sql import functions as F

from stocktake.functions.names import rename_safe
from stocktake.operators.shape import add_provenance
from stocktake.operators.snapshots import snapshot_pair
from stocktake.operators.summary import build_summary, ordered_summary


def test_rename_safe(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A.b` long, `a b` long, `x-y` long")
    assert rename_safe(df).columns == ["a_b", "a_b__1", "x_y"]


def test_snapshot_pair_slices_by_collection_time(spark):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    raw = spark.createDataFrame([(1, t1), (2, t1), (1, t2)], "k long, _collected_at timestamp")
    old, new = snapshot_pair(raw, "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert sorted(r["k"] for r in old.collect()) == [1, 2] and [r["k"] for r in new.collect()] == [1]


def test_prefixed_summary_and_order(spark):
    counts = spark.createDataFrame([("p_job", 1), ("p_sql_alerts", 2), ("uc_schemas", 3)], "key string, count long")
    rows = [(r["Category"], r["Object"]) for r in ordered_summary(build_summary(counts, prefix="p_")).collect()]
    assert rows == [("Auto", "Job"), ("Auto", "Sql Alerts"), ("Metastore", "UC Schemas")]


def test_provenance_from_page_columns_or_literals(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "w")], "a long, collected_at timestamp, workspace string")
    p = add_provenance(df)
    r = p.first()
    assert r["_workspace"] == "w" and r["_collected_at"] == dt.datetime(2024, 1, 1)
    q = add_provenance(df, "2024-02-01 00:00:00", "other").first()
    assert q["_workspace"] == "other" and q["_collected_at"] == dt.datetime(2024, 2, 1)
    assert F is not None
