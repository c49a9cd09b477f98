"""Discovery looks at distinct shapes of records; what it finds is what a row a leaf gives."""

import json

import pytest
from pyspark.sql import functions as F

from stocktake.operators import flatten
from stocktake.plans.queries import as_record, plain_record

ROWS = [
    {"a": 1, "b": {"c": "x", "d": None}, "B": 2},
    {"a": 2, "b": {"c": "y", "d": None}, "B": 2},
    {"a": 9007199254740993, "n": True, "z": [1, {"q": 2.5}]},
    {"a": 0.5, "b": "text", "x y": 1, "d\"q": 3, "k'q": 4},
    {"a": None, "b": {}, "B": "BIGINT", "b_json": "own"},
    {"n": 17.0, "e": 1e300, "deep": {"r": {"s": {"t": {"u": 1}}}}},
    {}, 5, [1, {"a": 2}], "word",
]


def _records(spark, rows=ROWS, times=2):
    rows = [(str(i % 2), json.dumps(r)) for i, r in enumerate(rows)] * times + [("0", None)]
    return spark.createDataFrame(rows, "g string, body string").select("g", F.try_parse_json("body").alias("rec"))


@pytest.mark.parametrize("keep", [None, "all", "group", "record"])
def test_shapes_find_what_leaves_give(spark, keep):
    lists = {None: None, "all": F.array(F.lit("a"), F.lit("n")), "group": F.when(F.col("g") == "1", F.array(F.lit("a"), F.lit("B"))),
             "record": F.when(F.try_variant_get("rec", "$.a", "bigint").isNotNull(), F.array(F.lit("a")))}
    df, counts, every = _records(spark), {}, {}
    found = flatten.discover(df, "rec", by=["g"], keep=lists[keep], counts_out=counts, inject=["n"])
    assert found == flatten.discover(df, "rec", by=["g"], keep=lists[keep], counts_out=every, inject=["n"], by_shape=False)
    assert counts == every == {("0",): 10, ("1",): 10}


def test_discovery_expands_a_shape_once(spark, monkeypatch):
    taken = []
    leaf_rows = flatten.leaf_rows
    monkeypatch.setattr(flatten, "leaf_rows", lambda df, *a, **k: (taken.append(df.count()), leaf_rows(df, *a, **k))[1])
    df = _records(spark, [{"job_id": i, "name": "n", "settings": {"retry": i}, "tags": [i]} for i in range(300)], 1)
    plans = flatten.discover(df, "rec", by=["g"], keep=F.array(F.lit("job_id")))
    assert sorted((c.name, c.type) for c in plans[("1",)]) == [("job_id", "bigint"), ("name", "string"), ("settings_json", "json"), ("tags_json", "json")]
    assert sum(taken) <= 2  # a shape in each group


def test_whole_numbers_meet_fractions(spark):
    found = lambda rows: {c.name: c.type for c in flatten.discover(_records(spark, rows, 1), "rec")[()]}
    assert found([{"a": 9007199254740993}, {"a": 0.5}]) == {"a": "decimal(17,1)"}
    assert found([{"a": 3}, {"a": 0.5}]) == {"a": "double"}
    many = [{f"k{i}": 2 ** 60 for i in range(flatten.SPAN_PATHS + 1)}, {f"k{i}": 0.5 for i in range(flatten.SPAN_PATHS + 1)}]
    assert set(found(many).values()) == {"decimal(20,1)"}


def test_own_keys_are_read_as_by_path(spark):
    df = _records(spark)
    plan = flatten.discover(df, "rec")[()]
    wide = flatten.flatten_wide(df, "rec", plan, ["g"])
    by_path = df.select("g", *[flatten.V.extract("rec", c.jpath, c.type, c.guard).alias(c.name) for c in plan])
    assert wide.columns == by_path.columns and sorted(map(str, wide.collect())) == sorted(map(str, by_path.collect()))


def test_plain_record_is_the_record(spark):
    df = spark.createDataFrame([(1, "a\"b", "O", 2.5), (None, "c", None, 1.0), (2 ** 62, None, "F", 17.0)], "k long, t string, s string, x double")
    cols = ["k", "t", F.struct("s").alias("inside")]
    for c in (cols, [*cols, "x"]):
        rows = df.select(F.schema_of_variant(plain_record(df, *c)), F.to_json(plain_record(df, *c)),
                         F.schema_of_variant(as_record(*c)), F.to_json(as_record(*c))).collect()
        assert [tuple(r)[:2] for r in rows] == [tuple(r)[2:] for r in rows]
