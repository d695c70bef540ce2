"""COPY FROM and TO, and the export and import of databases."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.files import read_csv
from tarn.workspace import filesystem


def copy_to(df: DataFrame, path: str, fmt: str = "csv", delimiter: str = ",", header: bool = False, null: str = "", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """csv, text (tab-separated with \\N), parquet, json or orc; a folder of part files."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "text":
        w.option("sep", "\t").option("nullValue", "\\N").option("header", header).option("quote", "").csv(path)
    elif fmt == "csv":
        w.option("sep", delimiter).option("header", header).option("nullValue", null).option("emptyValue", '""').csv(path)
    elif fmt in ("parquet", "json", "orc"):
        w.format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def copy_from(spark: SparkSession, path: str, schema: str, fmt: str = "csv", delimiter: str | None = None, header: bool | None = None, ignore_errors: bool = False, max_errors: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows and, for csv, rejects. Without ignore_errors a reject is an error; so are more than max_errors of them."""
    if fmt == "text":
        return spark.read.schema(schema).option("sep", "\t").option("nullValue", "\\N").option("quote", "").option("header", bool(header)).csv(path), None
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path), None
    rows, rejects = read_csv(spark, path, schema, delimiter, header)
    most = max_errors if ignore_errors else 0
    if most is not None and (n := len(rejects.limit(most + 1).collect())) > most:
        raise ValueError(f"at least {n} lines of {path} don't fit the table")
    return rows.drop("_filename"), rejects


def export_database(tables: dict[str, DataFrame], path: str) -> None:
    """A Parquet folder for each table and a manifest with schemas, rows and checksums, the sum over rows of a hash."""
    manifest = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = df.sparkSession.read.parquet(f"{path}/{name}")
        manifest[name] = {"schema": json.loads(df.schema.json()), **checksum(back)}
        spark = df.sparkSession
    if tables:
        fs, p = filesystem(spark, f"{path}/manifest.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(manifest, indent=1).encode()))
        out.close()


def checksum(df: DataFrame) -> dict:
    row = df.select(F.xxhash64(*[F.to_json(F.col(f"`{c}`").alias(c)) if k.startswith("map") else F.col(f"`{c}`") for c, k in df.dtypes]).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s")).first()
    return {"rows": row["n"], "checksum": row["s"]}


def import_database(spark: SparkSession, path: str, check: bool = True) -> dict[str, DataFrame]:
    """The tables of an export; a table that doesn't match its manifest is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])
    out = {}
    for name, about in manifest.items():
        df = spark.read.parquet(f"{path}/{name}")
        if check and (found := checksum(df)) != {k: about[k] for k in found}:
            raise ValueError(f"table {name} differs from its manifest")
        out[name] = df
    return out
