"""Micro-batches of self-contained listings with Structured Streaming.

Landed page files are read with a file-source ``readStream``; every micro-batch
goes through the same page rules, unnesting and shaping as a batch run inside
``foreachBatch`` (a stream cannot change its own schema; the batch function can).
Writes are idempotent per batch id, so a replayed micro-batch replaces its own rows.
This is the light path for endpoints without parents whose listings each land in one file.
``streaming.inventory`` takes everything else: listings that span files, children, the
catalog scan and the summary.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..fixed_values import SCHEMA_KEY, TABLE_KEY
from ..operators.shape import shape_records
from ..sinks.tables import InventorySink
from ..sources.landing import PAGE_SCHEMA, landed_records
from ..sources.registry import resolved_registry


def read_page_stream(spark: SparkSession, landing_dir: str, fmt: str = "json",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGE_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(landing_dir)


def process_batch(pages: DataFrame, batch_id: int, sink: InventorySink | None,
                  fn: Callable[[str, DataFrame], None] | None, prefix: str = "", policy: str = "prefix",
                  registry_options: dict | None = None) -> dict[str, int]:
    """Shape one micro-batch of pages and hand every raw dataset to the sink or ``fn``.

    Pages of child listings need their parents, which may lie in other micro-batches: they
    fail the batch instead of being left out.
    """
    spark = pages.sparkSession
    reg = resolved_registry(spark, prefix, **(registry_options or {}))
    children = [r["key"] for r in reg.where("parent_key IS NOT NULL").select("key").collect()]
    children += [SCHEMA_KEY, TABLE_KEY, prefix + SCHEMA_KEY, prefix + TABLE_KEY]
    if not pages.where(F.col("endpoint").isin(children)).isEmpty():
        raise ValueError("pages of child listings: use streaming.inventory.stream_inventory")
    recs = landed_records(pages, reg.where("parent_key IS NULL"), policy)
    found: dict = {}
    written = {}
    names = sink.stored_names() if sink is not None else None
    for (key,), df in shape_records(recs, keep=True, prefix=prefix, counts_out=found, names=names).items():
        if fn is not None:
            fn(key, df)                        # user callback per dataset (K11)
        if sink is not None:
            sink.write_raw(key, df, mode="append", batch_id=batch_id,
                           known_nonempty=found.get((key,), 0) > 0)
        written[key] = found.get((key,), 0)
    return written


def stream_raw(spark: SparkSession, landing_dir: str, checkpoint_location: str, sink: InventorySink | None = None,
               fn: Callable[[str, DataFrame], None] | None = None, fmt: str = "json",
               max_files_per_trigger: int | None = None, available_now: bool = True, prefix: str = "",
               policy: str = "prefix", registry_options: dict | None = None) -> StreamingQuery:
    """Start the incremental inventory; ``available_now`` drains the landing and stops."""
    stream = read_page_stream(spark, landing_dir, fmt, max_files_per_trigger)

    def each(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, sink, fn, prefix, policy, registry_options)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
