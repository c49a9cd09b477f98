"""Helpers shared by the text operators: inputs, stored intermediates, Arrow column maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stocktake.session import shared_path


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    It is computed once, its lineage ends at files every executor sees, and a lost executor
    costs a re-read.
    """
    path = shared_path(df.sparkSession, "llm", name)
    df.write.option("compression", "zstd").parquet(path)
    # shuffle files of finished steps go when the driver collects its garbage; a long chain of steps can't wait for that
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out_rows(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder`` (null ids: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_array(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column of a batch as a plain string array, nulls as empty texts."""
    arr = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(arr, "") if arr.null_count else arr


def append_columns(df: DataFrame, text_col: str, fields: Sequence[StructField],
                   make: Callable[[], Callable[[pa.Array], list[pa.Array]]], keep: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``df`` (columns ``keep``, all by default) plus columns computed from the text.

    ``make()`` runs once in each task and returns the function applied to every Arrow batch
    of texts. A narrow map: no shuffle, memory bounded by one batch.
    """
    names = list(df.columns if keep is None else keep)
    need = names if text_col in names else [*names, text_col]
    schema = StructType([*(df.schema[n] for n in names), *fields])
    arrow_names = names + [f.name for f in fields]

    def run(batches):
        fn = make()
        for batch in batches:
            if batch.num_rows:
                cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays(cols + fn(text_array(batch, text_col)), arrow_names)

    return df.select(*need).mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` has it (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
