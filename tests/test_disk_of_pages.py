"""What the stream's landing, page store and tables leave on disk is compressed; the rows are the same."""

import glob

from pyspark.sql import functions as F

from stocktake.functions.joins import checkpoint_once
from stocktake.plans.landing_builders import pack_pages
from stocktake.plans.queries import _page_files
from stocktake.session import shared_path
from stocktake.sources.landing import read_pages
from stocktake.streaming.inventory import add_pages


def _files(path):
    return [f for f in glob.glob(path.removeprefix("file:") + "/**/part-*", recursive=True)]


def test_landing_and_store_are_compressed(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.lit("a text that all records have").alias("t"))
    pages = pack_pages(df, "job", "jobs", F.floor(F.col("k") / 100) + 1, F.struct("k", "t"), F.col("k"))
    land, store = _page_files(spark, pages), shared_path(spark, "store")
    assert _files(land) and all(f.endswith(".json.gz") for f in _files(land))
    back = read_pages(spark, land, "json")
    assert sorted(map(str, back.collect())) == sorted(map(str, pages.select(back.columns).collect()))
    add_pages(back, 0, store)
    assert _files(store) and all(".zstd." in f for f in [*_files(store), *_files(checkpoint_once(back).inputFiles()[0].rsplit("/", 1)[0])])
    assert spark.read.parquet(f"{store}/pages").count() == 20
