"""An inverted-list index for approximate vector search: rows are stored by their nearest centroid, and a search reads a few lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.search import DISTANCES

#: Rows that centroids are fitted on, at most; every row is indexed.
SAMPLE = 20_000


class IvfIndex:
    def __init__(self, spark: SparkSession, path: str, vector: str, centroids: list[list[float]]):
        self.spark, self.path, self.vector, self.centroids = spark, path, vector, centroids

    @classmethod
    def build(cls, df: DataFrame, vector: str, path: str, lists: int = 32, seed: int = 7) -> IvfIndex:
        """Writes df to path, partitioned by list. Rows without a vector aren't indexed."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = df.where(F.col(vector).isNotNull()).withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
        sample = rows.select("__v", F.xxhash64(vector).alias("__h")).orderBy("__h").limit(SAMPLE).select("__v")
        model = KMeans(k=lists, seed=seed, featuresCol="__v", predictionCol="__list", maxIter=10).fit(sample)
        model.transform(rows).drop("__v").write.mode("overwrite").partitionBy("__list").parquet(path)
        return cls(df.sparkSession, path, vector, [c.tolist() for c in model.clusterCenters()])

    def search(self, query: list[float], k: int, probes: int = 8, metric: str = "l2", where: Column | None = None, ties: str | None = None) -> DataFrame:
        """The k nearest rows of the probes lists whose centroids are nearest; where is applied before the limit, so filters don't cost results of those lists."""
        far = [(sum((a - b) ** 2 for a, b in zip(c, query, strict=True)), i) for i, c in enumerate(self.centroids)]
        lists = [i for _, i in sorted(far)[:probes]]
        rows = self.spark.read.parquet(self.path).where(F.col("__list").isin(lists))
        rows = rows if where is None else rows.where(where)
        q = F.array(*(F.lit(float(x)) for x in query))
        return rows.withColumn("distance", DISTANCES[metric](F.col(self.vector), q)).orderBy("distance", *([ties] if ties else [])).limit(k).drop("__list")
