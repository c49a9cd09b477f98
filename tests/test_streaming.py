import os
import uuid

from pyspark.sql import functions as F

from stocktake.plans.landing_builders import pack_pages
from stocktake.session import shared_path
from stocktake.sinks.tables import InventorySink, ensure_schema
from stocktake.streaming.stream import stream_raw


def test_stream_equals_batch(spark):
    src = spark.range(0, 950).select(F.col("id").alias("job_id"), (F.col("id") % 7).alias("g"))
    pg = pack_pages(src, "job", "jobs", F.floor(F.col("job_id") / 50) + 1, F.struct("job_id", "g"),
                    F.col("job_id"), parent=F.floor(F.col("job_id") / 200).cast("string"))
    land = shared_path(spark, "test-landing")
    pg.repartition(3, "parent").write.json(land)
    schema = "s_" + uuid.uuid4().hex[:8]
    ensure_schema(spark, schema)
    sink = InventorySink(spark, schema)
    seen = []
    q = stream_raw(spark, land, shared_path(spark, "test-ckpt"), sink=sink, max_files_per_trigger=1,
                   fn=lambda key, df: seen.append(key))
    q.awaitTermination()
    t = spark.table(sink.table("job"))
    assert t.count() == 950 and t.select("job_id").distinct().count() == 950
    assert set(seen) == {"job"} and len(seen) >= 2
    assert os.path.basename(land)
