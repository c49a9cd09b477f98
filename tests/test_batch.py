"""The whole inventory written through the sink."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from stocktake.plans import scenario
from stocktake.plans.batch import run_batch
from stocktake.sinks.tables import InventorySink, ensure_schema, list_objects

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_run_batch_writes_raw_tables_and_summary(spark):
    schema = "inv_" + uuid.uuid4().hex[:8]
    ensure_schema(spark, schema)
    sink = InventorySink(spark, schema)
    pages = scenario.landing(spark, SF)
    summary = run_batch(spark, pages, sink, mounts=scenario.mounts(spark, SF))
    rows = {(r["Category"], r["Object"]): r["Count"] for r in summary.collect()}
    assert len(rows) == 33
    assert rows[("Auto", "Job")] == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert rows[("Metastore", "UC Catalogs")] == 5
    tables = {r["tableName"] for r in list_objects(spark, "tables", schema).collect()}
    assert {"raw_job", "raw_cluster", "raw_table", "raw_schema", "raw_dbfs_mount_points",
            "workspace_scan_summary"} <= tables
    # empty endpoints are skipped, not written
    assert "raw_pipeline" not in tables
    job = spark.table(sink.table("job"))
    assert job.count() == rows[("Auto", "Job")]
    assert {"job_id", "settings_json", "_collected_at", "_workspace"} <= set(job.columns)
    assert job.where(F.col("_workspace") != "ws-main").count() == 0
    # a second run replaces everything (drop first, overwrite)
    again = run_batch(spark, pages, sink, mounts=scenario.mounts(spark, SF))
    assert again.count() == 33
    assert spark.table(sink.table("job")).count() == rows[("Auto", "Job")]
