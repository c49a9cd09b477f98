"""Columns keep their paths over runs, and numbers keep their digits."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import records
from stocktake.operators.flatten import discover, flatten
from stocktake.plans.batch import run_batch
from stocktake.sinks.tables import InventorySink, ensure_schema
from stocktake.streaming.inventory import stream_inventory

BIG = 9007199254740993
PAGE = "workspace string, endpoint string, parent string, page_no int, status int, collected_at timestamp, body string"
RUN1, RUN2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def new_sink(spark, **kw):
    schema = "n_" + uuid.uuid4().hex[:10]
    ensure_schema(spark, schema)
    return InventorySink(spark, schema, **kw)


def landing(spark, runs):
    return spark.createDataFrame([("w", "repo", None, 1, 200, t, '{"repos": [%s]}' % ", ".join(recs)) for t, recs in runs], PAGE)


RUNS = [(RUN1, ['{"id": 1, "owner.id": "dotted"}']),
        (RUN2, ['{"id": 2, "owner.id": "dotted", "Owner id": "spaced", "owner": {"id": "nested"}}', '{"id": 3, "Owner id": "spaced"}'])]
WANT = {(1, "dotted", None, None), (2, "dotted", "spaced", "nested"), (3, None, "spaced", None)}


def columns_hold_one_field_each(df):
    got = {r["id"]: [r[c] for c in df.columns if c.startswith("owner_id")] for r in df.collect()}
    assert got[1][0] == "dotted" and got[1][1:] == [None, None]
    assert got[2][0] == "dotted" and sorted(got[2][1:]) == ["nested", "spaced"]
    assert got[3][0] is None and got[3][1:] == [x if x == "spaced" else None for x in got[2][1:]]


def test_appended_runs(spark):
    sink = new_sink(spark, raw_mode="append")
    for run in RUNS:
        run_batch(spark, landing(spark, [run]), sink, drop_first=False)
    columns_hold_one_field_each(spark.table(sink.table("repo")))


def test_overwritten_tables_keep_the_names_of_paths_that_come_back(spark):
    sink = new_sink(spark)
    only_spaced = (RUN2, ['{"id": 3, "Owner id": "spaced"}'])
    for run, want in ((RUNS[0], {"owner_id": "dotted"}), (only_spaced, {"owner_id__1": "spaced"}), (RUNS[0], {"owner_id": "dotted"})):
        run_batch(spark, landing(spark, [run]), sink, drop_first=False)
        row = spark.table(sink.table("repo")).first().asDict()
        assert {k: v for k, v in row.items() if k.startswith("owner")} == want


def test_streamed_runs(spark, tmp_path):
    sink = new_sink(spark)
    land, check = str(tmp_path / "land"), str(tmp_path / "check")
    for run in RUNS:
        landing(spark, [run]).write.mode("append").json(land)
        stream_inventory(spark, land, check, sink)
    columns_hold_one_field_each(spark.table(sink.table("repo")))


def test_new_names_go_behind_all_that_were_ever_used(spark):
    recs = records(spark, [(1, '{"A b": 1, "a.b": 2, "a_b": 3, "c": 4}')])
    plan = discover(recs, "rec", names={(): {"$['a']['b']": "a_b__4", "$['a.b']": "a_b"}})[()]
    assert {c.jpath: c.name for c in plan} == {"$['A b']": "a_b__5", "$['a_b']": "a_b__6", "$['a.b']": "a_b", "$['c']": "c"}


@pytest.mark.parametrize("values,want,texts", [
    ([str(BIG), "0.5"], "decimal(17,1)", [f"{BIG}.0", "0.5"]),
    (["1", "0.5"], "double", ["1.0", "0.5"]),
    ([str(2 ** 53), "0.5", "-3.25"], "double", ["9.007199254740992E15", "0.5", "-3.25"]),
    ([str(-BIG), "1e300"], "string", [str(-BIG), "1.0E300"]),
    (["12345678901234567890", "1"], "decimal(20,0)", ["12345678901234567890", "1"]),
    (["0.12345678901234567", "12345678901234567.5"], "decimal(34,17)", ["0.12345678901234567", "12345678901234567.50000000000000000"]),
    (["0.1234567890123456789012345", "12345678901234567890"], "string", ["0.1234567890123456789012345", "12345678901234567890"]),
    ([str(BIG), "true"], "string", [str(BIG), "true"]),
    ([str(BIG)], "bigint", [str(BIG)]),
])
def test_types_that_lose_no_digit(spark, values, want, texts):
    df = flatten(records(spark, [(i, '{"n": %s}' % v) for i, v in enumerate(values)]), "rec", ["id"])
    assert dict(df.dtypes)["n"] == want
    assert [r[0] for r in df.orderBy("id").select(F.col("n").cast("string")).collect()] == texts


def test_large_whole_numbers_survive_appends_and_streams(spark, tmp_path):
    runs = [(RUN1, ['{"id": 1, "n": %d}' % BIG]), (RUN2, ['{"id": 2, "n": 0.5}'])]
    sink = new_sink(spark, raw_mode="append")
    for run in runs:
        run_batch(spark, landing(spark, [run]), sink, drop_first=False)
    streamed = new_sink(spark)
    land, check = str(tmp_path / "land"), str(tmp_path / "check")
    for run in runs:
        landing(spark, [run]).write.mode("append").json(land)
        stream_inventory(spark, land, check, streamed)
    for s in (sink, streamed):
        rows = spark.table(s.table("repo")).select("id", F.col("n").cast("string").alias("n")).collect()
        assert {r["id"]: r["n"] for r in rows} == {1: f"{BIG}.0", 2: "0.5"}
