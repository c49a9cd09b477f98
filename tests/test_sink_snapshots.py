import uuid

from pyspark.sql import functions as F

from stocktake.operators.snapshots import snapshot_diff
from stocktake.sinks.tables import InventorySink, check_target, drop_matching, ensure_schema


def sink(spark, **kw):
    schema = "t_" + uuid.uuid4().hex[:10]
    ensure_schema(spark, schema)
    return InventorySink(spark, schema, **kw)


def test_append_evolves_schema(spark):
    s = sink(spark, raw_mode="append")
    s.write_raw("k", spark.createDataFrame([(1, 10)], "a long, b long"))
    s.write_raw("k", spark.createDataFrame([(2, "n")], "a long, c string"))
    s.write_raw("k", spark.createDataFrame([("3", 1.5)], "a string, b double"))
    t = spark.table(s.table("k"))
    assert dict(t.dtypes) == {"a": "string", "b": "double", "c": "string"}
    assert sorted((r["a"], r["b"], r["c"]) for r in t.collect()) == [("1", 10.0, None), ("2", None, "n"),
                                                                     ("3", 1.5, None)]


def test_skip_empty_and_placeholder(spark):
    s = sink(spark)
    empty = spark.createDataFrame([], "a long")
    assert s.write_raw("e", empty) is False
    s2 = sink(spark, skip_empty=False)
    assert s2.write_raw("e", empty, collected_at="2024-01-01", workspace="w") is True
    assert spark.table(s2.table("e")).columns == ["_empty", "_collected_at", "_workspace"]


def test_batch_writes_are_idempotent(spark):
    s = sink(spark)
    df = spark.createDataFrame([(1,), (2,)], "a long")
    s.write_raw("b", df, batch_id=0)
    s.write_raw("b", df, batch_id=0)
    s.write_raw("b", spark.createDataFrame([(3, "x")], "a long, z string"), batch_id=1)
    t = spark.table(s.table("b"))
    assert sorted((r["a"], r["_batch_id"]) for r in t.collect()) == [(1, 0), (2, 0), (3, 1)]


def test_drop_matching_and_target_check(spark):
    s = sink(spark)
    one = spark.createDataFrame([(1,)], "a long")
    s.write_raw("x", one)
    s.write_raw("y", one)
    one.write.format("parquet").saveAsTable(f"{s.schema}.keep_me")
    one.createOrReplaceTempView("raw_temp_view")
    dropped = drop_matching(spark, s.schema, exclude=["raw_y"])
    assert dropped == ["raw_x"]
    assert check_target(spark, s.schema) and not check_target(spark, "no_such_schema_here")


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "k long, v string")
    got = {r["k"]: (r["change"], r["changed_columns"]) for r in snapshot_diff(old, new, ["k"]).collect()}
    assert got == {1: ("unchanged", []), 2: ("changed", ["v"]), 3: ("unchanged", []), 4: ("added", [])}
    gone = {r["k"]: r["change"] for r in snapshot_diff(new, old, ["k"]).collect()}
    assert gone[4] == "removed"
    assert F is not None


def test_all_empty_records_write_placeholder(spark):
    from conftest import records
    from stocktake.operators.shape import shape_records
    recs = records(spark, [(1, "{}"), (2, "{}")]).select(
        F.lit("job").alias("endpoint"), F.current_timestamp().alias("collected_at"), F.lit("w").alias("workspace"),
        "rec")
    counts = {}
    shaped = shape_records(recs, keep=True, counts_out=counts)
    assert counts == {("job",): 2}
    s = sink(spark)
    assert s.write_raw("job", shaped[("job",)]) is True
    t = spark.table(s.table("job"))
    assert t.columns == ["_empty", "_collected_at", "_workspace"] and t.count() == 0
