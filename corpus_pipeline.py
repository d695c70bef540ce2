"""From documents to packed sequences: toxic documents go, repeated lines go, one document of each group of near-duplicates
stays, sources are mixed to their weights, and the mix is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All stages but the last return the columns of documents, and any further ones, whatever their names.

Documents with null or empty texts pass the first three stages as they are; the mix takes them as often as all of their source.
Rows with the same id and text are scored alike, keep the same lines, and count as copies of one document, of which one stays.
An empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import jaccard, lines, mixing, packing, toxicity
from tarn.llm.common import Workspace


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat go, with documents that consist of such lines alone."""
    out = lines.clean(docs, keep_emptied=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words a shingle, similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, shingle=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("n-gram Jaccard join", jaccard_stage), ("mixing sources to target weights", mixing_stage), ("packing", packing_stage)]

#: Learned scores, SimHashes and tokenizers are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, opened = Workspace(spark, "pipeline"), Workspace.opened(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, ws.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        ws.drop(before)
        Workspace.close_since(spark, opened)  # what the stage wrote for itself
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
