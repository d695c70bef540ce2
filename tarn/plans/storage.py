"""Sources, sinks and streams as queries. Each writes to the shared folder and reads back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tarn.plans.registry import query, table
from tarn.sources import copy, files
from tarn.streaming import views
from tarn.workspace import Workspace, filesystem

PART = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


KINDS = "p_partkey bigint, p_name string, p_size int, p_retailprice double"


def _put(spark, path: str, content: bytes) -> None:
    fs, p = filesystem(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content))
    out.close()


@query("source_csv", PART)
def csv_round_trip(spark, sf_dir):
    path = Workspace(spark, "csv").path("part")
    copy.copy_to(_part(spark, sf_dir), path, "csv", header=True)
    rows, _ = copy.copy_from(spark, path, KINDS, header=True)
    return rows


@query("source_csv_rejects", "SELECT * FROM (VALUES (1, 'a'), (2, 'b, c'), (4, NULL)) t(id, name)")
def csv_rejects(spark, sf_dir):
    path = Workspace(spark, "csv").path("rejects.csv")
    _put(spark, path, b'id,name\n1,a\n2,"b, c"\nthree,c\n4,\n5,e,extra\n')
    rows, _ = copy.copy_from(spark, path, "id int, name string", ignore_errors=True)
    return rows


@query("source_sniff_csv", "SELECT '|' AS Delimiter, true AS HasHeader, '{''id'': ''BIGINT'', ''price'': ''DOUBLE'', ''day'': ''DATE''}' AS Columns")
def sniff_csv(spark, sf_dir):
    path = Workspace(spark, "csv").path("sniff.csv")
    _put(spark, path, b"id|price|day\n1|2.5|2024-01-01\n2|3|2024-01-02\n")
    return files.sniff_csv(spark, path).select("Delimiter", "HasHeader", "Columns")


@query("source_row_numbers", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, 'z')) t(n, value)")
def row_numbers(spark, sf_dir):
    path = Workspace(spark, "text").path("lines.txt")
    _put(spark, path, b"x\ny\nz\n")
    return files.with_row_numbers(spark, path).select(F.col("_row_number").cast("int").alias("n"), "value")


for _fmt in ("parquet", "json", "orc", "text"):

    def _round_trip(spark, sf_dir, fmt=_fmt):
        path = Workspace(spark, fmt).path("part")
        copy.copy_to(_part(spark, sf_dir), path, fmt)
        return copy.copy_from(spark, path, KINDS, fmt)[0]

    query(f"source_{_fmt}", PART)(_round_trip)


@query("source_json_document", "SELECT * FROM (VALUES (1, 'a', 1.5), (2, NULL, 2.0)) t(id, s, x)")
def json_document(spark, sf_dir):
    path = Workspace(spark, "json").path("doc.json")
    _put(spark, path, b'[{"id": 1, "s": "a", "x": 1.5},\n {"id": 2, "x": 2}]')
    return files.read_json(spark, path).select(F.col("id").cast("int").alias("id"), "s", "x")


@query("source_arrow", "SELECT r_regionkey, r_name FROM region")
def arrow(spark, sf_dir):
    path = Workspace(spark, "arrow").path("region.arrow")
    rows = table(spark, sf_dir, "region").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, rows.schema) as w:
        w.write_table(rows)
    _put(spark, path, sink.getvalue().to_pybytes())
    return files.read_arrow(spark, path)


@query("source_partitioned", "SELECT count(*) AS n, round(sum(value), 4) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-03 12:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'")
def partitioned(spark, sf_dir):
    path = Workspace(spark, "days").path("events")
    copy.copy_to(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), path, "parquet", partition_by=["day"])
    rows = files.dates_scan(spark.read.parquet(path), "ts", "day", "2024-01-03 12:00:00", "2024-01-06 00:00:00")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"))


@query("source_json_table", "SELECT event_id, CAST(1 AS BIGINT) AS i, (props->>'$.k')::INT AS k, true AS there, false AS gone FROM events")
def json_table(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"items": ['), "props", F.lit("]}")).alias("doc"))
    return files.json_table(rows, "doc", "$.items[*]", [("i", "ordinality"), ("k", "int", "$.k"), ("there", "exists", "$.k"), ("gone", "exists", "$.z")]).drop("doc")


@query("source_json_table_rows", "SELECT n_nationkey, u.i::BIGINT AS i, CASE WHEN u.i = 1 THEN n_name END AS name FROM nation, (SELECT unnest(range(1, 4)) AS i) u WHERE u.i <= n_nationkey % 4")
def json_table_rows(spark, sf_dir):
    """From none to three rows a document; members are absent from all but the first, and a quarter of the documents have no list."""
    items = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_nationkey") % 4)), lambda i: F.when(i == 1, F.concat(F.lit('{"name": "'), "n_name", F.lit('"}'))).otherwise(F.lit("{}")))
    doc = F.when(F.col("n_nationkey") % 4 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"l": ['), F.array_join(items, ", "), F.lit("]}")))
    return files.json_table(table(spark, sf_dir, "nation").select("n_nationkey", doc.alias("doc")), "doc", "$.l[*]", [("i", "ordinality"), ("name", "string", "$.name")]).drop("doc")


@query("source_xml_table_rows", "SELECT n_nationkey, u.i::INTEGER AS i, CASE WHEN u.i % 2 = 0 THEN n_name ELSE 'none' END AS name FROM nation, (SELECT unnest(range(1, 4)) AS i) u WHERE u.i <= n_nationkey % 4")
def xml_table_rows(spark, sf_dir):
    """From none to three elements a document, of which only the second has a name."""
    row = lambda i: F.concat(F.lit('<n i="'), i.cast("string"), F.when(i % 2 == 0, F.concat(F.lit('"><name>'), "n_name", F.lit("</name></n>"))).otherwise(F.lit('"/>')))
    items = F.when(F.col("n_nationkey") % 4 == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_nationkey") % 4)), row), ""))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("<l>"), items, F.lit("</l>")).alias("doc"))
    return files.xml_table(rows, "doc", "/l/n", [("i", "int", "@i", None), ("name", "string", "name", "none")]).drop("doc")


@query("source_xml_table", "SELECT n_nationkey, n_name AS name, n_regionkey AS region, 'none' AS missing FROM nation")
def xml_table(spark, sf_dir):
    doc = F.concat(F.lit("<l><n><name>"), "n_name", F.lit("</name><r>"), "n_regionkey", F.lit("</r></n></l>"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", doc.alias("doc"))
    return files.xml_table(rows, "doc", "/l/n", [("name", "string", "name/text()", None), ("region", "int", "r/text()", None), ("missing", "string", "zzz/text()", "none")]).drop("doc")


@query("export_import", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def export_import(spark, sf_dir):
    path = Workspace(spark, "export").path("db")
    copy.export_database({t: table(spark, sf_dir, t) for t in ("nation", "region")}, path)
    back = copy.import_database(spark, path)
    return back["nation"].join(back["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("view_append", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 10")
def append_view(spark, sf_dir):
    ws = Workspace(spark, "view")
    folder, out, checkpoint = ws.path("in"), ws.path("out"), ws.path("checkpoint")
    rows = table(spark, sf_dir, "events")
    for i in range(2):  # the source grows between two refreshes
        rows.where(F.col("event_id") % 2 == i).write.mode("append").parquet(folder)
        views.append_view(views.source(spark, folder, rows.schema).where("event_type = 'click' AND value > 10").select("event_id", "value"), out, checkpoint)
    return spark.read.parquet(out)


@query("view_rollup", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY event_type")
def rollup_view(spark, sf_dir):
    ws = Workspace(spark, "rollup")
    folder, out, checkpoint = ws.path("in"), ws.path("out"), ws.path("checkpoint")
    rows = table(spark, sf_dir, "events")
    for i in range(2):
        rows.where(F.col("event_id") % 2 == i).write.mode("append").parquet(folder)
        views.rollup_view(views.source(spark, folder, rows.schema), ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("s")], out, checkpoint)
    return spark.read.parquet(out).withColumn("s", F.round("s", 4))


@query("time_buckets", "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M:%S') AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def time_buckets(spark, sf_dir):
    out = views.buckets(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["event_type"], [F.count("*").alias("n")])
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


@query("session_windows", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOURS THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s""")  # fmt: skip
def session_windows(spark, sf_dir):
    out = views.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "12 hours", "user_id", [F.count("*").alias("n")])
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
