"""Tables in the folder that driver and executors share; they cut lineage and outlive executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query go when it ends, rather than whenever the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset in local mode, as in tests, a temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        if not getattr(sc, "_tarn_dir", None):
            sc._tarn_dir = f"file://{tempfile.mkdtemp(prefix='tarn-')}"
        d = sc._tarn_dir
    return d.rstrip("/")


class Workspace:
    """Written tables of one job. drop() deletes what is no longer read; close_since() all tables of jobs whose results are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        self._all(spark).append(self.base)

    @staticmethod
    def _all(spark: SparkSession) -> list[str]:
        sc = spark.sparkContext
        if not hasattr(sc, "_tarn_bases"):
            sc._tarn_bases = []
        return sc._tarn_bases

    @classmethod
    def opened(cls, spark: SparkSession) -> int:
        """A mark for close_since()."""
        return len(cls._all(spark))

    @classmethod
    def close_since(cls, spark: SparkSession, mark: int = 0) -> None:
        """Deletes the tables of all workspaces opened since the mark (0: of the application)."""
        bases = cls._all(spark)
        for base in bases[mark:]:
            delete(spark, base)
        del bases[mark:]

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """df, written. Its plan runs this once, so Spark deletes its shuffle files as soon as the table is there."""
        path, before = self.path(name), self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._tarn_keep = self  # ids stay unique while the frame lives
        return out

    def drop(self, df: DataFrame) -> None:
        if path := self.paths.pop(id(df), None):
            delete(self.spark, path)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files that plans of others have left; those of tables go by themselves."""
        for _ in range(2):  # what the first leaves free in Python, the second finds in the JVM
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.1)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_tarn_shipped", False):
        return
    home = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp()) / "tarn_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(to))
    sc._tarn_shipped = True
