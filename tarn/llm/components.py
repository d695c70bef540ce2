"""Connected components of a graph of links, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import Workspace


def components(ws: Workspace, links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node and label (the smallest node of its component) of links (a, b), both bigint. Nodes without links have no row.

    Each round, a node takes the smallest label among its own and its neighbours', and then the label of that label, so
    that paths halve. Rounds end when no label changes. Neighbours are aggregated, never gathered, so a node with very many
    links costs one row a task; the join that looks up labels is one whose large partitions Spark splits.
    """
    edges = ws.table(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct().toDF("node", "other"), "edges")
    labels = ws.table(edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label"), F.lit(True).alias("moved")), "labels")
    for _ in range(most_rounds):
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
        near = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = ws.table(step, "step")
        roots = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = ws.table(step.join(roots, "label").select("node", F.col("root").alias("label"), (F.col("root") < F.col("old")).alias("moved")), "labels")
        ws.drop(labels)
        ws.drop(step)
        labels = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
