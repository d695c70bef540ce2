"""Readers of files: CSV with rejects, JSON, Parquet, Arrow, Iceberg snapshots, JSON_TABLE and XMLTABLE."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.workspace import filesystem, ship

HEAD = 1 << 16
CORRUPT = "__corrupt"


def head(spark: SparkSession, path: str, most: int = HEAD) -> bytes:
    """The first bytes of the first file that a path or pattern names, through Spark's readers."""
    row = spark.read.format("binaryFile").load(path).select("path").orderBy("path").first()
    if row is None:
        raise FileNotFoundError(path)
    fs, p = filesystem(spark, row[0])
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def csv_dialect(sample: str) -> dict:
    """delimiter, quote, escape, newline, whether there is a header, and column names and types, from the first lines."""
    try:
        d = csv.Sniffer().sniff(sample, delimiters=",;\t|")
        delimiter, quote = d.delimiter, d.quotechar or '"'
    except csv.Error:
        delimiter, quote = ",", '"'
    rows = [r for r in csv.reader(io.StringIO(sample), delimiter=delimiter, quotechar=quote) if r][:1000]
    kinds = lambda r: [_kind(x) for x in r]
    header = bool(rows) and all(k == "VARCHAR" for k in kinds(rows[0])) and (len(rows) == 1 or any(k != "VARCHAR" for k in kinds(rows[1])) or len(set(rows[0])) == len(rows[0]))
    body = rows[1:] if header else rows
    names = rows[0] if header else [f"column{i}" for i in range(len(rows[0]) if rows else 0)]
    types = [_join([_kind(r[i]) for r in body if i < len(r) and r[i] != ""]) for i in range(len(names))]
    newline = "\\r\\n" if "\r\n" in sample else "\\n"
    return {"delimiter": delimiter, "quote": quote, "escape": quote, "newline": newline, "skip": 0, "header": header, "columns": list(zip(names, types, strict=True))}


def _kind(x: str) -> str:
    import re

    if re.fullmatch(r"[-+]?\d{1,18}", x):
        return "BIGINT"
    if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", x):
        return "DOUBLE"
    if x.lower() in ("true", "false"):
        return "BOOLEAN"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", x):
        return "DATE"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?", x):
        return "TIMESTAMP"
    return "VARCHAR"


def _join(kinds: list[str]) -> str:
    s = set(kinds)
    return s.pop() if len(s) == 1 else "DOUBLE" if s == {"BIGINT", "DOUBLE"} else "TIMESTAMP" if s == {"DATE", "TIMESTAMP"} else "VARCHAR"


def sniff_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row with what the first bytes of a file say about its dialect."""
    d = csv_dialect(head(spark, path).decode("utf-8", "replace"))
    columns = "{" + ", ".join(f"'{n}': '{t}'" for n, t in d["columns"]) + "}"
    formats = ["%Y-%m-%d" if any(t == "DATE" for _, t in d["columns"]) else "", "%Y-%m-%d %H:%M:%S" if any(t == "TIMESTAMP" for _, t in d["columns"]) else ""]
    prompt = f"FROM read_csv('{path}', delim='{d['delimiter']}', header={str(d['header']).lower()})"
    row = (d["delimiter"], d["quote"], d["escape"], d["newline"], d["skip"], d["header"], columns, *formats, "", prompt)
    return spark.createDataFrame([row], "Delimiter string, Quote string, Escape string, NewLineDelimiter string, SkipRows int, HasHeader boolean, Columns string, DateFormat string, TimestampFormat string, UserArguments string, Prompt string")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, delimiter: str | None = None, header: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and rejects. Rows have the columns (nullable text unless a schema is given) and _filename; rejects have line, _filename and fields, what could be read of each.

    A line whose number of fields or types don't fit is a reject. The dialect is sniffed where it isn't given.
    """
    d = csv_dialect(head(spark, path).decode("utf-8", "replace"))
    names = T.StructType([T.StructField(n, T.StringType()) for n, _ in d["columns"]]) if schema is None else spark.createDataFrame([], schema).schema
    full = T.StructType([*names.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(full).option("sep", delimiter or d["delimiter"]).option("quote", d["quote"]).option("escape", d["escape"]).option("header", d["header"] if header is None else header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", "true")
    rows = reader.csv(path).withColumn("_filename", F.input_file_name())
    good = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, rows.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), "_filename", F.array(*(F.col(f"`{n}`").cast("string") for n in names.names)).alias("fields"))


def with_row_numbers(spark: SparkSession, path: str) -> DataFrame:
    """_filename, _row_number (from 1 in each file) and value of a text file's lines; files are numbered one task each."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                lines = content.as_py().decode("utf-8", "replace").splitlines()
                for at in range(0, len(lines), 50_000):
                    part = lines[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at + 1, at + 1 + len(part)), pa.int64()), pa.array(part)], names=["_filename", "_row_number", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "_filename string, _row_number bigint, value string")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that holds one array or object, or more; types are inferred by a scan unless a schema is given."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_ndjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; split at lines."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def arrow_table(content: bytes) -> pa.Table:
    """Of an IPC file or stream."""
    try:
        return pa.ipc.open_file(pa.BufferReader(content)).read_all()
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(pa.BufferReader(content)).read_all()


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """IPC files, each read by one task; the first file tells the schema."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.limit(1).collect()
    if not first:
        raise FileNotFoundError(path)
    schema = spark.createDataFrame(arrow_table(bytes(first[0][0])).slice(0, 0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from arrow_table(content.as_py()).to_batches(max_chunksize=10_000)

    return files.mapInArrow(run, schema)


def iceberg_files(spark: SparkSession, table_path: str, snapshot_id: int | None = None, where: dict | None = None) -> list[str]:
    """Data files of a snapshot, from the newest metadata file; manifests are read as Avro by Spark. where: identity partitions to keep."""
    base = table_path.rstrip("/")
    texts = spark.read.text(f"{base}/metadata/*.metadata.json", wholetext=True).withColumn("f", F.input_file_name()).orderBy(F.col("f").desc()).limit(1).collect()
    if not texts:
        raise FileNotFoundError(f"{base}/metadata")
    meta = json.loads(texts[0]["value"])
    wanted = snapshot_id if snapshot_id is not None else meta["current-snapshot-id"]
    snapshot = next((s for s in meta["snapshots"] if s["snapshot-id"] == wanted), None)
    if snapshot is None:
        raise ValueError(f"no snapshot {wanted}")
    manifests = [r[0] for r in spark.read.format("avro").load(snapshot["manifest-list"]).select("manifest_path").collect()]
    entries = spark.read.format("avro").load(manifests).where("status < 2")
    for k, v in (where or {}).items():
        entries = entries.where(F.col(f"data_file.partition.{k}") == F.lit(v))
    return [r[0] for r in entries.select("data_file.file_path").collect()]


def read_iceberg(spark: SparkSession, table_path: str, snapshot_id: int | None = None, where: dict | None = None) -> DataFrame:
    """With the connector, where the session has it; else from the snapshot's Parquet files, which needs Spark's Avro source."""
    try:
        reader = spark.read.format("iceberg")
        return (reader.option("snapshot-id", snapshot_id) if snapshot_id is not None else reader).load(table_path)
    except Exception as e:  # the class isn't there
        if "iceberg" not in str(e).lower():
            raise
    return spark.read.parquet(*iceberg_files(spark, table_path, snapshot_id, where))


def json_table(df: DataFrame, doc: str, rows_path: str, columns: list[tuple]) -> DataFrame:
    """df's columns and those of JSON_TABLE. columns: (name, "ordinality"), (name, type, path) or (name, "exists", path).

    rows_path and paths are plain: $, members and [*] at the rows' end. A document without rows_path gives no rows.
    """
    found = F.get_json_object(doc, rows_path.removesuffix("[*]"))
    items = F.from_json(found, "array<string>") if rows_path.endswith("[*]") else F.when(found.isNotNull(), F.array(found))
    out = df.select("*", F.posexplode(items).alias("__i", "__item"))
    made = []
    for c in columns:
        if c[1] == "ordinality":
            made.append((F.col("__i") + 1).cast("long").alias(c[0]))
        elif c[1] == "exists":
            made.append(F.get_json_object("__item", c[2]).isNotNull().alias(c[0]))
        else:
            made.append(F.get_json_object("__item", c[2]).cast(c[1]).alias(c[0]))
    return out.select(*df.columns, *made)


def xml_value(element: ElementTree.Element, path: str) -> str | None:
    """The first value at a path from an element: texts (text() or the path of an element) or an attribute (@name); null if there is none."""
    path, _, last = path.rpartition("/")
    if last == "text()" or last.startswith("@"):
        found = element.find(path) if path else element
    else:
        found = element.find(f"{path}/{last}" if path else last)
    if found is None:
        return None
    if last.startswith("@"):
        return found.get(last[1:])
    return found.text if last == "text()" else "".join(found.itertext())


def xml_rows(text: str | None, row: str, paths: list[str]) -> list[list[str | None]]:
    """The values of each element at the absolute path row."""
    if text is None:
        return []
    above = ElementTree.Element("above")
    above.append(ElementTree.fromstring(text))
    return [[xml_value(e, p) for p in paths] for e in above.findall(f".{row}")]


def xml_table(df: DataFrame, doc: str, row: str, columns: list[tuple[str, str, str, object]]) -> DataFrame:
    """df's columns and those of XMLTABLE. columns: (name, type, path, default); row: an absolute path of elements.

    Paths are evaluated for each row element, in the language of ElementTree with text() or @name at the end. A document
    without such elements, and a null one, gives no rows; a malformed one is an error.
    """
    ship(df.sparkSession)
    paths = [c[2] for c in columns]

    @F.pandas_udf("array<array<string>>")
    def rows(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: xml_rows(d, row, paths))

    out = df.select("*", F.explode(rows(doc)).alias("__row"))
    made = []
    for i, (name, kind, _, default) in enumerate(columns):
        value = F.get("__row", F.lit(i)).cast(kind)
        made.append((value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(name))
    return out.select(*df.columns, *made)


def dates_scan(df: DataFrame, ts: str, day: str, since: str, until: str) -> DataFrame:
    """Rows of a table partitioned by day with since <= ts < until; the days are compared too, so that other partitions aren't read."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return df.where((F.col(day) >= F.lit(since).cast("date")) & (F.col(day) <= F.lit(until).cast("date")) & (F.col(ts) >= at(since)) & (F.col(ts) < at(until)))

