"""Table sink with schema evolution.

Tables are Parquet folders behind a name that moves by one catalog statement (``commits``). Appends add
new columns, read missing ones as NULL and widen retyped ones to a type that holds every value of both
(BIGINT, DOUBLE, DECIMAL, STRING); no row is rewritten for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import RAW_TABLE_PREFIX, SUMMARY_TABLE
from ..functions.names import quote_ident, table_name
from ..operators.shape import EMPTY_MARK, empty_raw
from .commits import BATCH_COL, UNIT_COL, StoredTable



def list_objects(spark: SparkSession, kind: str, within: str | None = None) -> DataFrame:
    """SHOW CATALOGS / SCHEMAS / TABLES as DataFrames."""
    if kind == "catalogs":
        return spark.sql("SHOW CATALOGS")
    if kind == "schemas":
        return spark.sql(f"SHOW SCHEMAS IN {quote_ident(within)}" if within else "SHOW SCHEMAS")
    if kind == "tables":
        return spark.sql(f"SHOW TABLES IN {_qualify(within)}" if within else "SHOW TABLES")
    raise ValueError(kind)


def _qualify(name: str) -> str:
    return ".".join(quote_ident(p) for p in name.split("."))


def ensure_schema(spark: SparkSession, schema: str, catalog: str | None = None) -> None:
    """Create the target schema if missing (K8). Catalog creation is left to the platform."""
    target = ".".join(quote_ident(p) for p in (catalog, schema) if p)
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {target}")


def check_target(spark: SparkSession, schema: str, catalog: str | None = None) -> bool:
    """True when the target catalog and schema exist (K9)."""
    if catalog:
        cats = [r[0] for r in spark.sql("SHOW CATALOGS").collect()]
        if catalog not in cats:
            return False
    within = quote_ident(catalog) if catalog else None
    rows = spark.sql(f"SHOW SCHEMAS IN {within}" if within else "SHOW SCHEMAS").collect()
    return schema in [r[0] for r in rows]


def match_names(names: DataFrame, include: list[str], exclude: list[str] | None = None,
                col: str = "tableName") -> DataFrame:
    """Rows whose name contains any include pattern and no exclude pattern."""
    c = F.col(col)
    inc = F.lit(False)
    for p in include:
        inc = inc | c.contains(p)
    exc = F.lit(False)
    for p in exclude or []:
        exc = exc | c.contains(p)
    return names.where(inc & ~exc)


def drop_matching(spark: SparkSession, schema: str, catalog: str | None = None,
                  include: list[str] | None = None, exclude: list[str] | None = None,
                  raw_prefix: str = RAW_TABLE_PREFIX) -> list[str]:
    """Drop the tables of a schema that match the patterns; temp views are skipped (K7).

    Without patterns only this engine's own tables go: names that begin with the raw
    prefix, and the summary.
    """
    within = ".".join(p for p in (catalog, schema) if p)
    tables = list_objects(spark, "tables", within).where(~F.col("isTemporary"))
    if include is None:
        own = F.col("tableName").startswith(raw_prefix) | (F.col("tableName") == SUMMARY_TABLE)
        tables, include = tables.where(own), [""]
    names = [r["tableName"] for r in match_names(tables, include, exclude).select("tableName").collect()]
    for n in names:
        ident = table_name(catalog, schema, n, prefix="")
        if not StoredTable(spark, ident).drop():
            spark.sql(f"DROP {'VIEW' if spark.catalog.getTable(ident).tableType == 'VIEW' else 'TABLE'} IF EXISTS {ident}")
    return names


class InventorySink:
    """Writes raw tables and the summary into one target schema."""

    def __init__(self, spark: SparkSession, schema: str, catalog: str | None = None,
                 raw_mode: str = "overwrite", summary_mode: str = "overwrite", evolve: bool = True,
                 replace_schema: bool = False, skip_empty: bool = True, raw_prefix: str = RAW_TABLE_PREFIX, **options):
        self.spark, self.schema, self.catalog = spark, schema, catalog
        self.raw_mode, self.summary_mode = raw_mode, summary_mode
        self.evolve, self.replace_schema, self.skip_empty = evolve, replace_schema, skip_empty
        self.raw_prefix = raw_prefix
        self.options = options    # of StoredTable

    # -- naming -------------------------------------------------------------------------
    def table(self, key: str, raw: bool = True) -> str:
        return table_name(self.catalog, self.schema, key, self.raw_prefix if raw else "")

    def exists(self, ident: str) -> bool:
        return self.spark.catalog.tableExists(ident.replace("`", ""))

    def stored(self, ident: str) -> StoredTable:
        return StoredTable(self.spark, ident, **self.options)

    def stored_names(self) -> dict[tuple, dict[str, str]]:
        """Column of each record path that the raw tables have had, per key (P3); the tables keep them in their commits."""
        within = ".".join(p for p in (self.catalog, self.schema) if p)
        tables = list_objects(self.spark, "tables", within).where(~F.col("isTemporary") & F.col("tableName").startswith(self.raw_prefix))
        out = {}
        for r in tables.select("tableName").collect():
            key = r[0][len(self.raw_prefix):]
            now = self.stored(self.table(key)).current()
            if now is not None and now.names():
                out[(key,)] = now.names()
        return out

    # -- writes -------------------------------------------------------------------------
    def write_raw(self, key: str, df: DataFrame, mode: str | None = None, batch_id: int | None = None,
                  collected_at=None, workspace: str | None = None, known_nonempty: bool = False) -> bool:
        """Write one raw table (K1-K5). Returns False when an empty dataset was skipped.

        ``known_nonempty`` skips the emptiness probe (a job) when the caller already
        counted rows, e.g. a dataset found by discovery.
        """
        mode = mode or self.raw_mode
        ident = self.table(key)
        if EMPTY_MARK in df.columns:
            # records that all flattened to nothing: the zero-row placeholder is written
            # (an existing table in append mode keeps its schema)
            if mode == "overwrite" or not self.exists(ident):
                self.stored(ident).replace(df.drop(EMPTY_MARK))
            return True
        if not known_nonempty and df.isEmpty():
            if self.skip_empty:
                return False
            df = empty_raw(self.spark, collected_at, workspace)
        if batch_id is not None:
            # a replayed micro-batch replaces its own rows
            self.stored(ident).add(df.withColumn(BATCH_COL, F.lit(int(batch_id))), BATCH_COL, [int(batch_id)])
        elif mode == "overwrite" or not self.exists(ident):
            self.stored(ident).replace(df)
        else:
            self.stored(ident).add(df, evolve=self.evolve or self.replace_schema)
        return True

    def evolve_append(self, ident: str, df: DataFrame) -> None:
        """Append with new columns added, missing ones NULL, retyped ones widened (K2)."""
        self.stored(ident).add(df, evolve=self.evolve)

    def write_units(self, ident: str, df: DataFrame | None, units: list[str], held: set[str]) -> None:
        """Replace the rows of ``units`` by ``df`` (with UNIT_COL); units not in ``held`` have none left."""
        table = self.stored(ident)
        if df is not None and EMPTY_MARK in df.columns:
            if not table.exists():
                table.replace(df.drop(EMPTY_MARK))
            df = None
        if df is None:
            table.drop_values(UNIT_COL, units)
        else:
            table.add(df, UNIT_COL, units)

    def write_summary(self, summary: DataFrame, mode: str | None = None) -> None:
        """Summary table: appended, with wider types where its schema conflicts, or replaced (K6)."""
        ident = self.table(SUMMARY_TABLE, raw=False)
        if (mode or self.summary_mode) == "append" and self.exists(ident):
            self.stored(ident).add(summary)
        else:
            self.stored(ident).replace(summary)


__all__ = ["InventorySink", "list_objects", "ensure_schema", "check_target", "match_names", "drop_matching"]
