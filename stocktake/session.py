"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans joins and coalesces or splits
# partitions at run time, skew join splits hot keys, UTC keeps timestamps stable.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of an Arrow batch: long texts make large batches of the default 10,000.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Repeated keys in landed JSON: keep the last value, as JSON parsers commonly do.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Files of that many folders are open at a time in a task: pages and records are not sorted by folder before they are written.
    "spark.sql.maxConcurrentOutputFileWriters": "40",
    # The JVM never compiles methods of more bytes; flattening made larger ones, which ran interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str = "local[8]", app: str = "stocktake",
                  shuffle_partitions: int = 8, checkpoint_dir: str | None = None,
                  max_partition_bytes: str = "8m", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster the cluster's own session is used as is."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(SESSION_DEFAULTS)
    conf.update({
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        # Small local inputs: smaller splits keep every core busy on the CPU-heavy
        # parsing and flattening (clusters keep their own, larger setting).
        "spark.sql.files.maxPartitionBytes": max_partition_bytes,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    if master.startswith("local"):
        # local runs only; a cluster keeps its own shared warehouse
        conf["spark.sql.warehouse.dir"] = os.path.join(_scratch_root(), "warehouse")
    if checkpoint_dir:
        conf["spark.checkpoint.dir"] = checkpoint_dir
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _scratch_root() -> str:
    return os.environ.get("STOCKTAKE_SCRATCH", "/tmp/stocktake")


def apply_defaults(spark: SparkSession) -> None:
    """Set the runtime SQL settings on an existing session (cluster sessions included)."""
    for k, v in SESSION_DEFAULTS.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked setting: the cluster's value stands
            pass


def ensure_checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Only when the session has none (local tests) is a folder set here.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if default is None and not sc.master.startswith("local"):
            # a machine-local folder is not shared by the executors of a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        current = default or os.path.join(_scratch_root(), "checkpoints")
        os.makedirs(current, exist_ok=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), *parts, uuid.uuid4().hex])
