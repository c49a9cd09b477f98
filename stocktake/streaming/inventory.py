"""The whole inventory from a stream of landed pages (T1, T2, K11): raw tables, children, catalog scan, summary.

A collection run's pages arrive over many files and micro-batches, in any order, and children
may arrive before their parents. So micro-batches only add their pages to a page store, once
per batch id (a replay replaces its own folder). Evaluation then takes the units that new pages
touched (a unit: the collection day and one of BUCKETS shares of the workspaces, so a run lies
in one unit), applies the batch plan to all stored pages of these units and replaces their
partitions of the raw tables. The outcome is that of a batch run over the same pages; what
other days and workspaces left is neither read nor rewritten.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import COLLECTED_AT, COUNTER_KEYS, MOUNTS_KEY, SCHEMA_KEY, TABLE_KEY, WORKSPACE
from ..functions.joins import CODEC, checkpoint_once
from ..functions.parallel import each
from ..operators.hierarchy import uc_counters
from ..operators.summary import build_summary, ordered_summary
from ..plans.batch import build_inventory, counted_keys, mount_count, rename_single
from ..operators.shape import add_provenance
from ..sinks.tables import UNIT_COL, InventorySink
from ..sources.landing import PAGE_SCHEMA
from ..sources.registry import resolved_registry
from .stream import read_page_stream

#: Shares of the workspaces of one day that are evaluated and replaced together.
BUCKETS = 16
COUNTS_TABLE = "inventory_counts"
STORE_SCHEMA = f"{PAGE_SCHEMA}, batch long, {UNIT_COL} string"
_REGISTRY_OPTIONS = ("master_paging", "global_max_pages", "overrides", "enabled")


def unit_of(collected_at: Column, workspace: Column) -> Column:
    """The unit of a run: its day and its workspace's bucket."""
    return F.concat_ws("-", F.coalesce(F.date_format(collected_at, "yyyyMMdd"), F.lit("none")),
                       F.pmod(F.xxhash64(workspace), F.lit(BUCKETS)).cast("string"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def add_pages(batch: DataFrame, batch_id: int, store: str) -> None:
    """One micro-batch's pages into the store; the same batch again replaces them."""
    (batch.withColumn(UNIT_COL, unit_of(F.col("collected_at"), F.col("workspace")))
     .write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", CODEC)
     .partitionBy(UNIT_COL, "endpoint").parquet(f"{store}/pages/batch={int(batch_id)}"))


def evaluate(spark: SparkSession, store: str, sink: InventorySink, fn: Callable[[str, DataFrame], None] | None = None,
             **options) -> list[str]:
    """Evaluate the units with pages newer than the last evaluation; returns them.

    The batch is marked as evaluated last, so an evaluation that was cut off is repeated and
    replaces the same partitions. The driver sees one value per unit and dataset.
    """
    if not _exists(spark, f"{store}/pages"):
        return []
    pages = spark.read.schema(STORE_SCHEMA).parquet(f"{store}/pages")
    marks = f"{store}/evaluated"
    done = spark.read.schema("batch long").parquet(marks).agg(F.max("batch")).first()[0] if _exists(spark, marks) else None
    fresh = pages.where(F.col("batch") > F.lit(-1 if done is None else done))
    newest = fresh.agg(F.max("batch")).first()[0]
    if newest is None:
        return []
    units = sorted(r[0] for r in fresh.select(UNIT_COL).distinct().collect())
    prefix = options.get("prefix", "")
    inv = build_inventory(spark, pages.where(F.col(UNIT_COL).isin(units)).drop("batch", UNIT_COL), names=sink.stored_names(), **options)
    unit = unit_of(F.col("collected_at"), F.col("workspace"))
    counts = inv.listed.groupBy(F.col("endpoint").alias("key"), unit.alias(UNIT_COL)).agg(F.sum("_n").alias("count"))
    if inv.scan:
        counts = counts.unionByName(uc_counters(*inv.scan, by=unit).withColumnRenamed("group", UNIT_COL))
    counts = checkpoint_once(counts.select("key", F.col("count").cast("long").alias("count"), UNIT_COL))
    held: dict[str, set[str]] = {}
    for r in counts.where("count > 0").collect():
        held.setdefault(r["key"], set()).add(r[UNIT_COL])
    held[prefix + SCHEMA_KEY], held[prefix + TABLE_KEY] = held.get("uc_schemas", set()), held.get("uc_tables", set())

    keys = [r["key"] for r in resolved_registry(spark, prefix).select("key").collect()]
    every = [*keys, prefix + SCHEMA_KEY, prefix + TABLE_KEY]
    raw = {key: inv.raw[key] for key in every if held.get(key) and key in inv.raw}
    for key, df in raw.items() if fn is not None else ():
        fn(key, df)

    def write(key: str) -> None:
        df = raw.get(key)
        if df is not None:
            df = df.withColumn(UNIT_COL, unit_of(F.col(COLLECTED_AT), F.col(WORKSPACE)))
        sink.write_units(sink.table(key), df, units, held.get(key, set()))

    each(every, write)
    sink.write_units(sink.table(COUNTS_TABLE, raw=False), counts, units, set().union(*held.values()))
    spark.createDataFrame([(newest,)], "batch long").coalesce(1).write.mode("append").parquet(marks)
    return units


def summarise(spark: SparkSession, sink: InventorySink, mounts: DataFrame | None = None, prefix: str = "", **registry) -> DataFrame:
    """Write the summary of everything evaluated so far and return it ordered."""
    ident = sink.table(COUNTS_TABLE, raw=False)
    rows = (spark.table(ident) if sink.exists(ident)
            else spark.createDataFrame([], f"key string, count long, {UNIT_COL} string"))
    totals = rows.groupBy("key").agg(F.sum("count").alias("count"))
    reg_rows = resolved_registry(spark, prefix, *[registry.get(k, d) for k, d in zip(_REGISTRY_OPTIONS, (True, 0, None, None))]).collect()
    counters = spark.createDataFrame([(k,) for k in COUNTER_KEYS], "key string").join(F.broadcast(totals), "key", "left").select(
        "key", F.coalesce("count", F.lit(0)).alias("count"))
    counts = counted_keys(spark, totals, reg_rows).unionByName(mount_count(spark, mounts)).unionByName(counters)
    sink.write_summary(build_summary(counts, prefix, [r["key"] for r in reg_rows]))
    return ordered_summary(spark.table(sink.table("workspace_scan_summary", raw=False)))


def stream_inventory(spark: SparkSession, landing_dir: str, checkpoint_location: str, sink: InventorySink,
                     store: str | None = None, fn: Callable[[str, DataFrame], None] | None = None, fmt: str = "json",
                     max_files_per_trigger: int | None = None, every_batch: bool = False, mounts: DataFrame | None = None,
                     mount_col: str = "path", **options) -> DataFrame:
    """Drain the landing into the page store, evaluate what is new and return the ordered summary.

    ``store`` defaults to a folder beside the checkpoint, whose batch ids it shares. ``every_batch``
    evaluates after each micro-batch instead of once after the drain. ``fn`` receives every
    dataset evaluated (K11). ``options`` are those of ``build_inventory``.
    """
    store = store or checkpoint_location.rstrip("/") + "-store"

    def each(batch: DataFrame, batch_id: int) -> None:
        add_pages(batch, batch_id, store)
        if every_batch:
            evaluate(batch.sparkSession, store, sink, fn, **options)

    stream = read_page_stream(spark, landing_dir, fmt, max_files_per_trigger)
    (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location)
     .trigger(availableNow=True).start().awaitTermination())
    evaluate(spark, store, sink, fn, **options)
    if mounts is not None:
        m = rename_single(mounts, mount_col)
        sink.write_raw(MOUNTS_KEY, add_provenance(m).drop("collected_at", "workspace") if "collected_at" in m.columns else m,
                       mode="overwrite")
    return summarise(spark, sink, mounts, options.get("prefix", ""),
                     **{k: options[k] for k in _REGISTRY_OPTIONS if k in options})


__all__ = ["unit_of", "add_pages", "evaluate", "summarise", "stream_inventory"]
