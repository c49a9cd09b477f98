from pyspark.sql import functions as F

from conftest import records
from stocktake.operators.flatten import discover, flatten, flatten_long


def wide(spark, rows, keep=None):
    df = flatten(records(spark, rows), "rec", ["id"], keep=keep)
    return df, {r["id"]: r.asDict() for r in df.collect()}


def test_nested_leaves_and_null_leaf(spark):
    df, rows = wide(spark, [(1, '{"a":{"b":[1,{"c":null}]}}')])
    assert set(df.columns) == {"id", "a_b_0", "a_b_1_c"}
    assert rows[1]["a_b_0"] == 1 and rows[1]["a_b_1_c"] is None


def test_empty_containers_vanish_but_json_path_keeps_them(spark):
    df, _ = wide(spark, [(1, '{"a":{},"l":[],"k":1}')])
    assert set(df.columns) == {"id", "k"}
    df2, rows2 = wide(spark, [(1, '{"a":{},"l":[],"k":1}')], keep=F.array())
    assert set(df2.columns) == {"id", "a_json", "l_json", "k"}
    assert rows2[1]["a_json"] == "{}" and rows2[1]["l_json"] == "[]"


def test_scalar_record_is_value(spark):
    df, rows = wide(spark, [(1, '"admins"')])
    assert df.columns == ["id", "value"] and rows[1]["value"] == "admins"


def test_all_empty_objects_give_no_columns(spark):
    df, _ = wide(spark, [(1, "{}"), (2, "{}")])
    assert df.columns == ["id"]


def test_repeated_names_get_suffixes(spark):
    df, rows = wide(spark, [(1, '{"A":1,"a":2,"a.b":3,"x":{"b":4}}'), (2, '{"a":{"b":5}}')])
    assert {"a", "a__1", "a_b", "a_b__1", "x_b"} <= set(df.columns)
    assert rows[1]["a"] == 1 and rows[1]["a__1"] == 2
    assert {rows[1]["a_b"], rows[1]["a_b__1"]} == {3, None}
    assert {rows[2]["a_b"], rows[2]["a_b__1"]} == {5, None}


def test_underscore_key_and_symbol_key(spark):
    df, rows = wide(spark, [(1, '{"_catalog":"c","()":1}')])
    assert set(df.columns) == {"id", "catalog", "_blank"}
    assert rows[1]["catalog"] == "c" and rows[1]["_blank"] == 1


def test_missing_int_is_null_bigint(spark):
    df, rows = wide(spark, [(1, '{"n":1}'), (2, '{"m":true}')])
    assert dict(df.dtypes)["n"] == "bigint" and rows[2]["n"] is None
    assert dict(df.dtypes)["m"] == "boolean"


def test_type_lattice(spark):
    df, rows = wide(spark, [(1, '{"s":1,"d":1,"x":null}'), (2, '{"s":"x","d":2.5}')])
    types = dict(df.dtypes)
    assert types["s"] == "string" and types["d"] == "double" and types["x"] == "string"
    assert rows[1]["s"] == "1" and rows[2]["d"] == 2.5


def test_scalar_and_object_under_one_key(spark):
    df, rows = wide(spark, [(1, '{"a":"x"}'), (2, '{"a":{"b":2}}')])
    assert rows[1]["a"] == "x" and rows[1]["a_b"] is None
    assert rows[2]["a"] is None and rows[2]["a_b"] == 2


def test_json_suffix_beside_genuine_field(spark):
    df, rows = wide(spark, [(1, '{"a":{"z":1},"a_json":"genuine"}')], keep=F.array())
    assert {"a_json", "a_json__1"} <= set(df.columns)
    assert {rows[1]["a_json"], rows[1]["a_json__1"]} == {'{"z":1}', "genuine"}


def test_keep_list_types(spark):
    df, rows = wide(spark, [(1, '{"k":1,"other":2,"flag":true,"o":{"p":1}}')], keep=F.array(F.lit("k")))
    types = dict(df.dtypes)
    assert types["k"] == "bigint" and types["other"] == "string" and types["flag"] == "string"
    assert rows[1]["other"] == "2" and rows[1]["flag"] == "true" and rows[1]["o_json"] == '{"p":1}'


def test_deep_records_are_not_cut(spark):
    deep = '{"a":' * 20 + "1" + "}" * 20
    df, rows = wide(spark, [(1, deep)])
    assert df.columns == ["id", "_".join(["a"] * 20)] and rows[1]["_".join(["a"] * 20)] == 1


def test_long_form_matches_wide(spark):
    rows = [(1, '{"a":{"b":[1,2]},"c":"x"}'), (2, '{"a":{"b":[3]},"d":null}')]
    long = flatten_long(records(spark, rows), "rec", ["id"])
    got = {(r["id"], r["path"], r["kind"]) for r in long.collect()}
    assert got == {(1, "a.b[0]", "I"), (1, "a.b[1]", "I"), (1, "c", "S"), (2, "a.b[0]", "I"), (2, "d", "N")}


def test_weird_keys_address_correctly(spark):
    df, rows = wide(spark, [(1, '{"a]b":1,"it\'s":2,"x.y[0]":3,"ünï":4}')])
    assert rows[1]["a_b"] == 1 and rows[1]["it_s"] == 2 and rows[1]["x_y_0"] == 3 and rows[1]["ünï"] == 4


def test_key_with_both_quote_kinds(spark):
    df, rows = wide(spark, [(1, '{"a\'b\\"c":1,"o":{"x\'\\"y":{"z":[5]}}}'), (2, '{"a\'b\\"c":"t"}')])
    assert rows[1]["a_b_c"] == "1" and rows[2]["a_b_c"] == "t"
    assert rows[1]["o_x_y_z_0"] == 5 and rows[2]["o_x_y_z_0"] is None
    df2, rows2 = wide(spark, [(1, '{"q\'\\"":{"p":1}}')], keep=F.array())
    assert rows2[1]["q_json"] == '{"p":1}'


def test_wide_maps_become_json_text(spark):
    import json
    rows = [(i, json.dumps({"id": i, "tags": {f"k{i}_{j}": j for j in range(50)}, "o": {"a": i}})) for i in range(40)]
    out = flatten(records(spark, rows), "rec", ["id"], max_columns=100)
    assert sorted(out.columns) == ["id", "id", "o_a", "tags_json"]
    got = out.select("o_a", "tags_json").collect()
    assert {r["o_a"]: json.loads(r["tags_json"]) for r in got} == {i: json.loads(b)["tags"] for i, b in rows}


def test_record_that_is_a_wide_map_keeps_its_rows(spark):
    import json
    rows = [(i, json.dumps({f"k{i}_{j}": j for j in range(50)})) for i in range(10)]
    found = {}
    plans = discover(records(spark, rows), "rec", max_columns=100, counts_out=found)
    assert [(c.name, c.type) for c in plans[()]] == [("value", "json")] and found[()] == 10
