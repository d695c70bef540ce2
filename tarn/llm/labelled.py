"""Bounded samples of labelled rows, for the operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_ids(labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """doc_id and y (0 or 1) of at most `most` rows of each class, those with the smallest hashes of their ids.

    labels: doc_id and label; rows where either is null, or where usable isn't true, are left out. An id that occurs more
    than once counts once, as 1 if any of its rows says so.
    """
    rows = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", (F.col(label) > 0).cast("int").alias("y"))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("at", F.xxhash64("doc_id"))
    parts = [rows.where(F.col("y") == y).orderBy("at", "doc_id").limit(most) for y in (0, 1)]
    return parts[0].unionAll(parts[1]).select("doc_id", "y")


def with_sample(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text and y of the sampled rows. ids has at most twice sample_ids()'s bound of rows, so it is broadcast and docs aren't shuffled."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
