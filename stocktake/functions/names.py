"""Column-name rules as Spark expressions (lower-case, replace, collapse, trim, suffix)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed_values import DEDUP_SEPARATOR, NAME_REPLACED_CHARS, RAW_TABLE_PREFIX

# Name used when cleaning leaves nothing (a key made of symbols only). It starts with
# "_", which no cleaned name can, so it never clashes with a real field.
BLANK_NAME = "_blank"

_CHAR_CLASS = "[" + "".join(re.escape(c) for c in NAME_REPLACED_CHARS) + "]"


def clean_name(col: Column | str) -> Column:
    """lower-case, listed characters -> '_', runs of '_' -> one, trim '_' at both ends."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    c = F.regexp_replace(c, _CHAR_CLASS, "_")
    c = F.regexp_replace(c, "_+", "_")
    c = F.regexp_replace(c, "^_|_$", "")
    return F.when(c == "", F.lit(BLANK_NAME)).otherwise(c)


def with_suffix(name: Column, repeat_no: Column) -> Column:
    """n-th repeat of a cleaned name gets '__n'; the first keeps the plain name."""
    return F.when(repeat_no == 0, name).otherwise(F.concat(name, F.lit(DEDUP_SEPARATOR), repeat_no.cast("string")))


def dedup_small(df: DataFrame, name_col: str, order_cols: list[str], by: list[str] | None = None,
                out: str = "name") -> DataFrame:
    """Suffix repeats of ``name_col`` within ``by``; for small name lists (schemas)."""
    w = Window.partitionBy(*(by or []), name_col).orderBy(*order_cols)
    return df.withColumn(out, with_suffix(F.col(name_col), F.row_number().over(w) - 1))


def safe_column_names(spark: SparkSession, names: list[str]) -> list[str]:
    """Clean and de-duplicate a list of column names, in the given order."""
    if not names:
        return []
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, raw string")
    df = dedup_small(df.withColumn("clean", clean_name("raw")), "clean", ["ord"])
    return [r["name"] for r in df.orderBy("ord").select("name").collect()]


def rename_safe(df: DataFrame) -> DataFrame:
    """Give every column of ``df`` its safe name (one projection, no data pass)."""
    new = safe_column_names(df.sparkSession, df.columns)
    return df.select([F.col(quote_ident(old)).alias(n) for old, n in zip(df.columns, new)])


def display_name(key: Column, prefix: str = "") -> Column:
    """Object label: drop the platform prefix anywhere, '_' -> ' ', title case."""
    c = F.replace(key, F.lit(prefix), F.lit("")) if prefix else key
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table_name(catalog: str | None, schema: str | None, key: str, prefix: str = RAW_TABLE_PREFIX) -> str:
    """Back-quoted table identifier; catalog and schema parts are optional."""
    parts = [p for p in (catalog, schema) if p] + [f"{prefix}{key}"]
    return ".".join(quote_ident(p) for p in parts)
