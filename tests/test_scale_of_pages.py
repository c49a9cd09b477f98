import glob
import json
import os
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stocktake.functions.joins import checkpoint_once
from stocktake.operators import flatten
from stocktake.plans import queries, scenario
from stocktake.plans.landing_builders import pack_pages
from stocktake.session import apply_defaults

from conftest import records


def test_wide_rows_are_kept_in_small_row_groups(spark):
    # 4096 rows are decoded at a time, but never beyond a row group
    wide = spark.range(3000, numPartitions=1).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.sha2(
        F.concat(F.col("id").cast("string"), i.cast("string")), 512))).alias("body"))
    kept = checkpoint_once(wide)
    groups = [g for f in kept.inputFiles() for g in [pq.ParquetFile(f.removeprefix("file:")).metadata]]
    assert max(m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)) < 40 << 20
    assert kept.count() == 3000


def test_folders_are_written_without_sorting_pages(spark):
    apply_defaults(spark)
    out = checkpoint_once(spark.range(20).select("id", (F.col("id") % 3).cast("string").alias("endpoint")), by=["endpoint"])
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) > 0
    assert sorted(r[0] for r in out.select("id").collect()) == list(range(20))


def test_own_keys_of_keep_list_records_take_one_level(spark):
    df = records(spark, [(1, '{"a":1,"b":{"c":[1,{"d":2}]}}'), (2, '[[{"e":1}],{"a":2}]'), (3, '{}'), (4, '"x"')])
    keep = F.when(F.col("id") < 10, F.array(F.lit("a")))
    rows = flatten._discovered_rows(df, "rec", ["id"], 3, 1, keep)
    assert {r["_p"] for r in rows.where("id = 1").collect()} == {"", "a", "b_json"}
    named = lambda plans: sorted((c.jpath, c.path, c.type) for c in plans[()])
    # an array beside objects still gets all its levels
    assert ("$[0][0]['e']", "[0][0].e", "bigint") in named(flatten.discover(df, "rec", keep=F.array(F.lit("a"))))


def test_only_the_endpoints_asked_for_are_landed(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    for f in os.listdir(src):
        os.symlink(os.path.join(src, f), tmp_path / f)
    pages = scenario.landing(spark, str(tmp_path), endpoints=["catalog"])
    assert {r[0] for r in pages.select("endpoint").distinct().collect()} == {"catalog"}
    path, there = scenario._LANDED[(spark.sparkContext.applicationId, str(tmp_path))]
    assert there == {"catalog"} and [os.path.basename(p) for p in glob.glob(path.removeprefix("file:") + "/*")] == ["endpoint=catalog"]
    assert scenario.landing(spark, str(tmp_path), endpoints=["schema"]).count() == 5


def test_short_listings_are_packed_in_one_exchange(spark):
    rows = [(o, n) for o in range(40) for n in range(1, 1 + random.Random(o).randint(1, 5))] + [(None, 1), (3, 1)]
    df = spark.createDataFrame(rows, "o long, n long")
    make = lambda **k: pack_pages(df, "job", "jobs", F.col("n"), F.struct("o", "n"), F.col("n"), parent=F.col("o"), **k)
    short = make(by_listing=True)
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert sorted(map(str, short.collect())) == sorted(map(str, make().collect()))


def test_keep_lists_copies_no_row_for_its_cells(spark, tmp_path):
    spark.createDataFrame([(1, 5, "F"), (2, None, "O"), (2, 7, None)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(
        f"{tmp_path}/orders.parquet")
    out = queries.q_keep_lists(spark, str(tmp_path))
    assert "Generate explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["endpoint"], r["field"]): (r["n"], r["total"], r["json"]) for r in out.collect()}
    assert got["catalog", "name"] == (3, 5, None) and got["catalog", "left_over"] == (2, 12, None)
    assert got["catalog", "inside_json"][0] == 3 and got["catalog", "inside_json"][1] is None


def test_orders_of_several_columns_are_not_nested(spark):
    # sort_array makes a new ordering for each two nested structs it compares, most of the time of a page
    rows = [(o, (o * 7 + n) % 5 or None, n) for o in range(6) for n in range(20)] + [(1, 2, 3), (1, 2, 3)]
    df = spark.createDataFrame(rows, "o long, k long, n long")
    pages = pack_pages(df, "job", "jobs", F.col("o"), F.struct("n", "k"), F.struct("k", "n"))
    plan = pages._jdf.queryExecution().analyzed().toString()
    assert "sort_array(collect_list(struct(_o0" in plan
    for p in pages.collect():
        want = sorted(((k is not None, k or 0, n) for o, k, n in rows if o == p["page_no"]))
        assert [(r["n"], r.get("k")) for r in json.loads(p["body"])["jobs"]] == [(n, k if has else None) for has, k, n in want]


def test_large_landings_have_larger_files(spark, monkeypatch):
    pages = lambda n: checkpoint_once(spark.range(n, numPartitions=1).select(
        F.lit("w").alias("workspace"), F.lit("job").alias("endpoint"), F.lit(None).cast("string").alias("parent"),
        F.col("id").cast("int").alias("page_no"), F.lit("{}").alias("body")))
    monkeypatch.setattr(queries, "PAGES_PER_FILE", 10)
    monkeypatch.setattr(queries, "PAGE_FILES", 20)
    for n, per_file in ((50, 10), (200, 10), (1000, 50)):
        landed = pages(n)
        assert queries._pages_per_file(landed) == per_file
        files = spark.read.json(queries._page_files(spark, landed, per_file=queries._pages_per_file(landed)))
        assert n // per_file <= len(files.inputFiles()) <= n // per_file + 8
        assert sorted(r[0] for r in files.select("page_no").collect()) == list(range(n))


def test_discovery_carries_no_record_beside_its_leaves(spark):
    df = records(spark, [(1, '{"a":1,"b":1.25,"c":{"d":[true,null]},"":"x"}'), (2, '{"a":9007199254740993,"b":"t"}'), (3, '{}'), (4, '[{"":2}]')])
    keep = F.when(F.col("id") < 10, F.array(F.lit("a")))
    rows = flatten.leaf_rows(df, "rec", ["id"], 2, keep)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # the keep-list and a container's own value do not go through the second level's generators
    generators = [line for line in plan.splitlines() if "Generate " in line]
    assert len(generators) == 4
    assert flatten._step(flatten._start(df, "rec", ["id"], keep), ["id"], True).columns == ["id", "_p", "_j", "_v", "_k"]
    got = {(r["id"], r["_j"]): (r["_p"], r["_k"]) for r in rows.drop("_v").collect()}
    assert got[1, "$['c']"] == ("c_json", "J") and got[1, "$['']"] == ("", "F") and got[1, "$['b']"] == ("b", "F")
    assert got[1, "$['a']"] == ("a", "I") and got[4, "$[0]['']"] == ("[0].", "I") and got[3, "$"] == ("", "O")
    plans = {c.jpath: c.type for c in flatten.discover(df, "rec")[()]}
    assert plans["$['a']"] == "bigint" and plans["$['b']"] == "string" and plans["$['c']['d'][0]"] == "boolean"
    numbers = records(spark, [(1, '{"a":1.25,"b":1.25}'), (2, '{"a":9007199254740993,"b":2}')])
    assert {c.jpath: c.type for c in flatten.discover(numbers, "rec")[()]} == {"$['a']": "decimal(18,2)", "$['b']": "double"}
