"""DESCRIBE, SUMMARIZE and EXPLAIN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def describe(df: DataFrame) -> DataFrame:
    """column_name, data_type, nullable and ordinal of each column."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, nullable boolean, ordinal int")


def summarize(df: DataFrame) -> DataFrame:
    """row_count, null_count, min, max, unique_count, avg and stddev of each column, exact, in one pass and one row that is then turned."""
    aggs, parts = [F.count(F.lit(1)).alias("__rows")], []
    for i, f in enumerate(df.schema):
        c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
        simple = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        aggs += [F.count(c).alias(f"n{i}"), (F.min(c).cast("string") if simple else F.lit(None).cast("string")).alias(f"lo{i}"), (F.max(c).cast("string") if simple else F.lit(None).cast("string")).alias(f"hi{i}"), (F.count_distinct(c) if not isinstance(f.dataType, T.MapType) else F.lit(None).cast("long")).alias(f"u{i}")]
        aggs += [(F.avg(c).cast("double") if number else F.lit(None).cast("double")).alias(f"a{i}"), (F.stddev(c) if number else F.lit(None).cast("double")).alias(f"s{i}")]
        parts.append(F.struct(F.lit(f.name).alias("column_name"), F.col("__rows").alias("row_count"), (F.col("__rows") - F.col(f"n{i}")).alias("null_count"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"u{i}").alias("unique_count"), F.col(f"a{i}").alias("avg"), F.col(f"s{i}").alias("stddev")))
    return df.agg(*aggs).select(F.inline(F.array(*parts)))


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
