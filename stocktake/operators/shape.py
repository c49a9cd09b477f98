"""Records -> analysis-ready raw tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import COLLECTED_AT, EMPTY_PLACEHOLDER_COLUMN, WORKSPACE

# Column marking a placeholder that must be written even though it has no rows.
EMPTY_MARK = "__placeholder"
from ..sources.registry import keep_fields_col
from .flatten import DEFAULT_MAX_COLUMNS, discover, flatten_wide


def add_provenance(df: DataFrame, collected_at: Column | str | datetime | None = None,
                   workspace: Column | str | None = None) -> DataFrame:
    """``_collected_at`` (timestamp) and ``_workspace`` on every row.

    Defaults take both from the landed page columns ``collected_at``/``workspace``.
    """
    ts = F.col("collected_at") if collected_at is None else (
        collected_at if isinstance(collected_at, Column) else F.lit(collected_at).cast("timestamp"))
    ws = F.col("workspace") if workspace is None else (workspace if isinstance(workspace, Column) else F.lit(workspace))
    return df.withColumn(COLLECTED_AT, ts).withColumn(WORKSPACE, ws)


def empty_raw(spark: SparkSession, collected_at=None, workspace: str | None = None) -> DataFrame:
    """Zero-row placeholder with the single ``_empty`` column plus provenance."""
    df = spark.createDataFrame([], f"{EMPTY_PLACEHOLDER_COLUMN} string")
    return df.withColumn(COLLECTED_AT, F.lit(collected_at).cast("timestamp")).withColumn(WORKSPACE, F.lit(workspace))


def shape_records(records: DataFrame, by: list[str] | None = None, keep: Column | None | bool = True,
                  inject: dict[str, Column] | None = None, prefix: str = "", provenance: bool = True,
                  max_columns: int = DEFAULT_MAX_COLUMNS, counts_out: dict | None = None,
                  names: dict[tuple, dict[str, str]] | None = None) -> dict[tuple, DataFrame]:
    """One wide DataFrame per group of ``by`` (default: per endpoint).

    ``keep=True`` applies the per-type keep-lists (types without one are flattened
    fully); ``keep=None`` flattens everything; a Column gives the keep-list per row.
    One discovery job serves all groups; each group is then one narrow projection
    whose endpoint filter reaches the page scan. ``names`` holds the columns that a group's paths
    have had before (``InventorySink.stored_names``); each column carries its path as metadata.
    """
    by = list(by or ["endpoint"])
    if keep is True:
        keep = keep_fields_col(F.col(by[0]), prefix)
    elif keep is False:
        keep = None
    inject = inject or {}
    found: dict = {}
    plans = discover(records, "rec", by=by, keep=keep, max_columns=max_columns, inject=list(inject),
                     counts_out=found, names=names)
    if counts_out is not None:
        for g, n in found.items():
            counts_out[g] = counts_out.get(g, 0) + n
    out = {}
    # Records that flatten to nothing (all `{}`): a zero-row placeholder table.
    for g, n in found.items():
        if n and g not in plans:
            out[g] = empty_raw(records.sparkSession).withColumn(EMPTY_MARK, F.lit(True))
    for g, plan in plans.items():
        cond = None
        for c, val in zip(by, g):
            # plain equality reaches the scan as a partition filter
            e = F.col(c).isNull() if val is None else (F.col(c) == F.lit(val))
            cond = e if cond is None else cond & e
        sub = records.where(cond) if cond is not None else records
        cols = [F.col("collected_at").alias("__ts"), F.col("workspace").alias("__ws")] if provenance else []
        wide = flatten_wide(sub, "rec", plan, keep_cols=cols, inject=inject)
        if provenance:
            names = [c for c in wide.columns if c not in ("__ts", "__ws", COLLECTED_AT, WORKSPACE)]
            wide = wide.select(*[F.col(f"`{c}`") for c in names],
                               F.col("__ts").alias(COLLECTED_AT), F.col("__ws").alias(WORKSPACE))
        out[g] = wide
    return out
