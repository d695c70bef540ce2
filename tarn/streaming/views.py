"""Incremental views by Structured Streaming: append-maintained ones, rollups, time buckets and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, files_a_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def append_view(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Brings a view of filters and projections up to date with its source; each input file is taken once."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def rollup_view(stream: DataFrame, keys: list, aggregates: list, path: str, checkpoint: str) -> None:
    """Keeps a rollup's current rows at path: the state is updated by what is new, and the whole result replaces the last one."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.groupBy(*keys).agg(*aggregates).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace).trigger(availableNow=True).start()
    q.awaitTermination()


def buckets(df: DataFrame, ts: str, width: str, keys: list[str], aggregates: list) -> DataFrame:
    """Aggregates by tumbling windows; bucket is a window's start."""
    return df.groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("bucket"), *keys, *(F.col(n) for n, _ in _named(aggregates)))


def _named(aggregates: list) -> list[tuple[str, object]]:
    return [(str(a._jc.toString()).rpartition(" AS ")[2].strip("`"), a) for a in aggregates]


def sessions(df: DataFrame, ts: str, gap: str, key: str, aggregates: list) -> DataFrame:
    """Aggregates by sessions of a key, which end where nothing follows for the gap."""
    return df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(*aggregates).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(F.col(n) for n, _ in _named(aggregates)))


def windowed_stream(stream: DataFrame, ts: str, late: str, width: str, keys: list[str], aggregates: list, path: str, checkpoint: str) -> None:
    """Appends finished windows; rows later than the watermark allows are left out."""
    rows = buckets(stream.withWatermark(ts, late), ts, width, keys, aggregates)
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, f: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(f).trigger(availableNow=True).start().awaitTermination()
