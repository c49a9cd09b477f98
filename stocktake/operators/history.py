"""Validity intervals of objects over any number of collection runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import COLLECTED_AT, WORKSPACE
from ..functions.joins import join_checked, materialize_small
from ..functions.names import quote_ident

VALID_FROM, VALID_TO, RUNS = "valid_from", "valid_to", "n_runs"


def object_history(raw: DataFrame, keys: list[str], compare: list[str] | None = None, ts_col: str = COLLECTED_AT,
                   workspace_col: str = WORKSPACE) -> DataFrame:
    """Every state of every object with the runs it was seen in, from an appended raw table.

    One row per object, state and unbroken stretch of its workspace's runs: the keys, the compared columns (all others
    by default), the workspace, ``valid_from`` (its first run), ``valid_to`` (the first run that saw another state or no
    such object; NULL while the last run still saw it) and ``n_runs``. A state that comes back, or an object that
    was gone for a run, gives a new row. NULL equals NULL. Of several rows of an object in one run the
    smallest counts; rows without a run time are left out.

    One shuffle by key; each key's window holds one row a run. The runs are a narrow side of one row a
    workspace and run, written once, measured, and broadcast only if small.
    """
    compare = [c for c in raw.columns if c not in (*keys, ts_col, workspace_col)] if compare is None else compare
    state = F.struct(*[F.col(quote_ident(c)).alias(f"c{i}") for i, c in enumerate(compare)], F.lit(0).alias("z"))
    # fixed names inside, so that no column of the table clashes with the operator's own
    rows = raw.where(F.col(quote_ident(ts_col)).isNotNull()).select(
        F.col(quote_ident(workspace_col)).alias("w"), F.col(quote_ident(ts_col)).alias("ts"),
        F.struct(*[F.col(quote_ident(k)).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), state.alias("state"))
    rows = rows.groupBy("w", "key", "ts").agg(F.min("state").alias("state"))
    order = Window.partitionBy("rw").orderBy("rts")
    runs = raw.where(F.col(quote_ident(ts_col)).isNotNull()).select(
        F.col(quote_ident(workspace_col)).alias("rw"), F.col(quote_ident(ts_col)).alias("rts")).distinct()
    runs = runs.withColumn("run", F.row_number().over(order)).withColumn("next", F.lead("rts").over(order))
    runs, size = materialize_small(runs)
    seen = join_checked(rows, runs, rows["w"].eqNullSafe(runs["rw"]) & (rows["ts"] == runs["rts"]), small_bytes=size)
    by_key = Window.partitionBy("w", "key").orderBy("run")
    same = F.lag("state").over(by_key).eqNullSafe(F.col("state")) & (F.lag("run").over(by_key) == F.col("run") - 1)
    seen = seen.withColumn("starts", (~F.coalesce(same, F.lit(False))).cast("int"))
    seen = seen.withColumn("stretch", F.sum("starts").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    out = seen.groupBy("w", "key", "stretch").agg(
        F.min(F.struct("ts", "state")).alias("first"), F.max(F.struct("run", "next")).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.select(*[F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)],
                      *[F.col(f"first.state.c{i}").alias(c) for i, c in enumerate(compare)], F.col("w").alias(workspace_col),
                      F.col("first.ts").alias(VALID_FROM), F.col("last.next").alias(VALID_TO), F.col("n").alias(RUNS))


def as_of(history: DataFrame, when: Column | str) -> DataFrame:
    """The objects as the last run at or before ``when`` saw them."""
    when = when if isinstance(when, Column) else F.lit(when).cast("timestamp")
    return history.where((F.col(VALID_FROM) <= when) & (F.col(VALID_TO).isNull() | (when < F.col(VALID_TO))))


__all__ = ["object_history", "as_of"]
