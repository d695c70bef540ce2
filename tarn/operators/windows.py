"""Window frames that Spark's SQL lacks: GROUPS, and EXCLUDE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, name: str, aggregate: Column, partition: list[str], by: list[Column], before: int, after: int) -> DataFrame:
    """aggregate OVER (PARTITION BY ... ORDER BY ... GROUPS BETWEEN before PRECEDING AND after FOLLOWING): peers are numbered, and the numbers are a range."""
    peers = Window.partitionBy(*partition).orderBy(*by)
    w = Window.partitionBy(*partition).orderBy("__group").rangeBetween(-before, after)
    return df.withColumn("__group", F.dense_rank().over(peers)).withColumn(name, aggregate.over(w)).drop("__group")


def exclude_current_sum(value: Column, w) -> Column:
    """sum(value) over a frame that holds the current row, without it; NULL when nothing else is there."""
    others = F.count(value).over(w) - value.isNotNull().cast("int")
    return F.when(others > 0, F.sum(value).over(w) - F.coalesce(value, F.lit(0)))


def exclude_current_count(value: Column, w) -> Column:
    return F.count(value).over(w) - value.isNotNull().cast("int")


def exclude_peers(df: DataFrame, name: str, value: str, key: str, row: str, w, ties_only: bool, fold: str = "sum") -> DataFrame:
    """sum, min, max or count of value over the frame w without the current row's peers (EXCLUDE GROUP), or without its peers but with itself (EXCLUDE TIES).

    key: the order key; row: a unique column. The frame is gathered for each row, so it should be narrow.
    """
    frame = F.collect_list(F.struct(F.col(key).alias("k"), F.col(row).alias("r"), F.col(value).alias("v"))).over(w)
    out = df.withColumn("__frame", frame)
    keep = lambda x: ~x["k"].eqNullSafe(F.col(key)) | (x["r"] == F.col(row) if ties_only else F.lit(False))
    left = F.filter(F.transform(F.filter("__frame", keep), lambda x: x["v"]), lambda v: v.isNotNull())
    folds = {"min": F.array_min(left), "max": F.array_max(left), "count": F.size(left).cast("long"), "sum": F.when(F.size(left) > 0, F.aggregate(left, F.lit(0).cast(df.schema[value].dataType), lambda s, v: s + v))}
    return out.withColumn(name, folds[fold]).drop("__frame")
