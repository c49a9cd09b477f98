"""Differences between two inventory snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import COLLECTED_AT
from ..functions.names import quote_ident


def snapshot_pair(raw: DataFrame, old_ts, new_ts, ts_col: str = COLLECTED_AT) -> tuple[DataFrame, DataFrame]:
    """Two slices of an appended raw table by collection time (filters reach the scan)."""
    return (raw.where(F.col(ts_col) == F.lit(old_ts).cast("timestamp")).drop(ts_col),
            raw.where(F.col(ts_col) == F.lit(new_ts).cast("timestamp")).drop(ts_col))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], compare: list[str] | None = None) -> DataFrame:
    """Per key: added, removed, changed or unchanged, plus the changed column names.

    One full outer join on the key (both sides shuffle by key once); columns compare
    with null-safe equality, so NULL -> value is a change and NULL -> NULL is not.
    """
    compare = compare or [c for c in new.columns if c in old.columns and c not in keys]
    o = old.select(*[F.col(quote_ident(c)).alias(f"o_{c}") for c in keys + compare], F.lit(True).alias("_in_old"))
    n = new.select(*[F.col(quote_ident(c)).alias(f"n_{c}") for c in keys + compare], F.lit(True).alias("_in_new"))
    cond = None
    for k in keys:
        e = F.col(f"o_{k}") == F.col(f"n_{k}")
        cond = e if cond is None else cond & e
    j = o.join(n, cond, "full_outer")
    diffs = [F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.lit(c)) for c in compare]
    changed = F.array_compact(F.array(*diffs)) if diffs else F.array().cast("array<string>")
    change = (F.when(F.col("_in_old").isNull(), F.lit("added"))
              .when(F.col("_in_new").isNull(), F.lit("removed"))
              .when(F.size(changed) > 0, F.lit("changed"))
              .otherwise(F.lit("unchanged")))
    key_cols = [F.coalesce(F.col(f"n_{k}"), F.col(f"o_{k}")).alias(k) for k in keys]
    return j.select(*key_cols, change.alias("change"),
                    F.when(F.col("_in_old").isNotNull() & F.col("_in_new").isNotNull(), changed)
                     .otherwise(F.array().cast("array<string>")).alias("changed_columns"))
