"""Catalogue views, prepared statements, cursors and statistics of a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables, of the current database and of temporary views."""
    rows = [(t.database or "", t.name, "LOCAL TEMPORARY" if t.isTemporary else "VIEW" if t.tableType == "VIEW" else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def columns(spark: SparkSession, *names: str) -> DataFrame:
    """information_schema.columns of the named tables, or of all."""
    rows = []
    for name in names or [t.name for t in spark.catalog.listTables()]:
        rows += [(name, f.name, i, "YES" if f.nullable else "NO", f.dataType.simpleString()) for i, f in enumerate(spark.table(name).schema, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


class Prepared:
    """A statement with named parameters (:name); each execution plans it with its values."""

    def __init__(self, spark: SparkSession, text: str, **views: DataFrame):
        self.spark, self.text, self.views = spark, text, views

    def execute(self, **args) -> DataFrame:
        return self.spark.sql(self.text, args=args, **self.views)


def cursor(df: DataFrame, size: int = 1000) -> Iterator[list[Row]]:
    """Rows in lists of a size; one partition at a time comes to the driver."""
    part: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics of all columns, for the cost-based optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def set_config(spark: SparkSession, name: str, value: str) -> str:
    spark.conf.set(name, value)
    return value


def session_facts(spark: SparkSession) -> DataFrame:
    """version, catalog, database, schema, user and the time of the statement."""
    return spark.range(1).select(F.version().alias("version"), F.current_catalog().alias("current_catalog"), F.current_database().alias("current_database"), F.current_schema().alias("current_schema"), F.current_user().alias("current_user"), F.current_timestamp().alias("now"), F.current_date().alias("today"))


def late_top_k(df: DataFrame, key: str, by: list, k: int) -> DataFrame:
    """The k first rows of a wide table: the order is found on the key and the sort columns alone, then k rows are fetched."""
    narrow = df.orderBy(*by, key).limit(k).select(key)
    return df.join(F.broadcast(narrow), key)  # k rows
