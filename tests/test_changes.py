"""Upserts, table functions and ranks on inputs with repeats, absent parts and nulls."""

import pytest
from pyspark.sql import functions as F

from tarn.functions import documents
from tarn.operators import relational
from tarn.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_of_repeated_and_null_keys(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y"), (None, "m"), (None, "m")], "k int, v string")
    kept = relational.upsert(target, new, ["k"], update=False, order=[F.col("v")])
    assert rows(kept) == sorted([(1, "a"), (2, "b"), (3, "y"), (None, "n"), (None, "m"), (None, "m")], key=str)
    inserted = relational.upsert(target, new, ["k"], update=False, order=[F.col("v")], returning=True)
    assert rows(inserted) == sorted([(3, "y"), (None, "m"), (None, "m")], key=str)
    with pytest.raises(Exception, match="change a row twice"):
        relational.upsert(target, new, ["k"]).collect()
    once = new.where("v <> 'z'")
    assert rows(relational.upsert(target, once, ["k"])) == sorted([(1, "a"), (2, "x"), (3, "y"), (None, "n"), (None, "m"), (None, "m")], key=str)
    joined = relational.upsert(target, once.where("k IS NOT NULL"), ["k"], values={"v": F.concat("t.v", "s.v")}, returning=True)
    assert rows(joined) == [(2, "bx"), (3, "y")]


def test_merge_counts_repeats_but_of_null_keys(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    clauses = [("matched", None, {"v": F.col("s.v")}), ("not matched", None, {"k": F.col("s.k"), "v": F.col("s.v")})]
    new = spark.createDataFrame([(1, "x"), (None, "m"), (None, "m")], "k int, v string")
    assert rows(relational.merge(target, new, ["k"], clauses)) == sorted([(1, "x"), (None, "m"), (None, "m")], key=str)
    with pytest.raises(Exception, match="change a row twice"):
        relational.merge(target, new.unionAll(new), ["k"], clauses).collect()


def test_xml_table_by_row_element(spark):
    docs = ["<l><n i='7'><a>1</a></n><n><a>2</a><b>y<c>z</c></b></n></l>", "<l/>", None, "<n><a>9</a></n>"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, d string")
    got = files.xml_table(df, "d", "/l/n", [("a", "int", "a", None), ("b", "string", "b", "none"), ("t", "string", "b/text()", None), ("i", "int", "@i", None)])
    assert rows(got.drop("d")) == [(0, 1, "none", None, 7), (0, 2, "yz", "y", None)]


def test_json_table_without_rows(spark):
    docs = ['{"l": [{"a": 1}, {}, null]}', "{}", None, '{"l": []}', '{"o": {"a": 5}}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, d string")
    assert rows(files.json_table(df, "d", "$.l[*]", [("i", "ordinality"), ("a", "int", "$.a")]).drop("d")) == [(0, 1, 1), (0, 2, None), (0, 3, None)]
    assert rows(files.json_table(df, "d", "$.o", [("i", "ordinality"), ("a", "int", "$.a")]).drop("d")) == [(4, 1, 5)]


def test_jsonb_set_makes_parents(spark):
    texts = ['{"a": 1}', '{"x": {"z": 2}}', '{"x": 3}']
    df = spark.createDataFrame([(t,) for t in texts], "d string").repartition(1)
    put = lambda create: [r[0] for r in df.select(documents.jsonb_set(F.col("d"), ["x", "y"], F.lit("9"), create)).collect()]
    assert put(True) == ['{"a":1,"x":{"y":9}}', '{"x":{"z":2,"y":9}}', '{"x":{"y":9}}'] or put(True) == ['{"a":1,"x":{"y":9}}', '{"x":{"y":9,"z":2}}', '{"x":{"y":9}}']
    assert put(False) == ['{"a":1}', '{"x":{"z":2}}', '{"x":3}']


def test_ranked_by_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit("clash").alias("before")).repartition(7)
    out = relational.ranked(df, "n", [F.col("v").desc()])
    assert out.columns == ["v", "before", "n"]
    got = out.orderBy(F.col("v").desc()).collect()
    assert [r.n for r in got] == list(range(1, 5001))
    assert relational.ranked(df.limit(0), "n", [F.col("v")]).count() == 0
    assert rows(relational.numbered(spark.createDataFrame([("b",), ("a",)], "k string"), "s", 10, 5, [F.col("k")])) == [("a", 10), ("b", 15)]


def test_quantiles_of_odd_groups(spark):
    """As Spark's own: null groups and values, groups of nulls alone, single values, ties and NaN."""
    data = [("a", float(i % 7), float(i)) for i in range(101)] + [(None, 1.5, None), (None, None, 2.0), (None, 4.0, -3.0)] + [("n", None, None), ("one", 3.0, -0.0)]
    data += [("b", 5.0, float(i // 2)) for i in range(40)] + [("nan", float("nan"), 1.0), ("nan", 2.0, float("inf"))]
    df = spark.createDataFrame(data, "k string, x double, y double").repartition(5)
    cuts, want = {}, []
    for kind in ("cont", "disc"):
        for c in "xy":
            for f in (0.0, 0.25, 0.5, 0.9, 1.0):
                name = f"{kind}_{c}_{int(f * 100)}"
                cuts[name] = (kind, c, f)
                want.append(f"percentile_{kind}({f}D) WITHIN GROUP (ORDER BY {c}) AS {name}")
    expected = spark.sql(f"SELECT k, {', '.join(want)} FROM {{df}} GROUP BY k", df=df)
    plain = lambda df: [tuple("NaN" if v != v else v for v in r) for r in rows(df)]
    assert plain(relational.quantiles(df, ["k"], cuts)) == plain(expected)
    assert relational.quantiles(df.where("false"), ["k"], cuts).count() == 0


def test_percentiles_do_not_gather_groups(spark):
    from tarn import plans

    df = plans.QUERIES["agg_percentiles"](spark, "/root/testdata/sf0.001")
    assert "percentile" not in df._jdf.queryExecution().toString().lower()
