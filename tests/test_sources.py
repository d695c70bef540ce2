"""Files: rejects, dialects, exports and streams."""

import pytest
from pyspark.sql import functions as F

from tarn.sources import copy, files
from tarn.streaming import views


def test_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,a\nx,b\n3,"c,d"\n')
    rows, rejects = copy.copy_from(spark, str(tmp_path / "a.csv"), "id int, name string", ignore_errors=True)
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (3, "c,d")]
    assert [r.line for r in rejects.select("line", "fields").collect()] == ["x,b"]
    with pytest.raises(ValueError):
        copy.copy_from(spark, str(tmp_path / "a.csv"), "id int, name string")
    copy.copy_from(spark, str(tmp_path / "a.csv"), "id int, name string", ignore_errors=True, max_errors=1)


def test_text_columns_without_a_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;v\n1;2\n")
    rows, _ = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert [(r.id, r.v) for r in rows.collect()] == [("1", "2")]


@pytest.mark.parametrize(("text", "delimiter", "header", "types"), [("a,b\n1,x\n", ",", True, ["BIGINT", "VARCHAR"]), ("1\t2.5\n3\t4\n", "\t", False, ["BIGINT", "DOUBLE"]), ("d|b\n2024-01-01|true\n", "|", True, ["DATE", "BOOLEAN"])])
def test_dialects(text, delimiter, header, types):
    d = files.csv_dialect(text)
    assert (d["delimiter"], d["header"], [t for _, t in d["columns"]]) == (delimiter, header, types)


def test_damaged_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    copy.export_database({"t": df}, str(tmp_path / "db"))
    assert copy.import_database(spark, str(tmp_path / "db"))["t"].count() == 2
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "db" / "t"))
    with pytest.raises(ValueError):
        copy.import_database(spark, str(tmp_path / "db"))


def test_late_rows(spark, tmp_path):
    at = lambda s: F.lit(s).cast("timestamp")
    src = str(tmp_path / "in")
    for i, stamps in enumerate((["2024-01-01 00:01:00", "2024-01-01 02:00:00"], ["2024-01-01 00:02:00", "2024-01-01 04:00:00"], ["2024-01-01 08:00:00"])):
        for s in stamps:
            spark.range(1).select(at(s).alias("ts")).write.mode("append").parquet(src)
        stream = views.source(spark, src, spark.read.parquet(src).schema)
        views.windowed_stream(stream, "ts", "30 minutes", "1 hour", [], [F.count("*").alias("n")], str(tmp_path / "out"), str(tmp_path / "check"))
    got = {str(r.bucket): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01 00:00:00"] == 1  # the second row of that hour came too late
