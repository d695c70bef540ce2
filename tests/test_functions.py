"""Semantics on small inline tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import casts, collections, documents, jsonpath, scalar, search, temporal
from tarn.operators import describe, relational, retrieval, rollup, windows


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_strings(spark):
    s = F.lit("héllo")
    assert one(spark, scalar.left(s, -2), scalar.right(s, -2), scalar.left(s, 9), scalar.right(s, 9), scalar.left(s, -9), scalar.right(s, 0)) == ("hél", "llo", "héllo", "héllo", "", "")
    assert one(spark, scalar.substring(s, 0, 3), scalar.substring(s, -2, 4), scalar.substring(s, 2)) == ("hé", "h", "éllo")
    assert one(spark, scalar.trim(F.lit("　 a b\t\n")), scalar.concat(F.lit("a"), F.lit(None).cast("string"), F.lit(True), booleans=(2,))) == ("a b", "at")
    assert one(spark, scalar.regexp_replace(F.lit("a$a\na"), "a", "$x"), scalar.regexp_replace(F.lit("xAxa"), "(a)", r"[\1\&]", "gi"), scalar.regexp_replace(F.lit("b\nab"), "(a)(b)", r"\2\1")) == ("$x$a\na", "x[AA]x[aa]", "b\nba")
    assert one(spark, scalar.format_text("%s|%I|%L|%%", F.lit(1), F.lit('a"b'), F.lit(None).cast("string"))) == ('1|"a""b"|NULL|%',)
    with pytest.raises(ValueError):
        scalar.split_part(s, "l", 0)


def test_numbers(spark):
    assert one(spark, scalar.round_double(F.lit(2.5)), scalar.round_double(F.lit(3.5)), scalar.truncate(F.lit(-2.7)), scalar.int_divide(F.lit(-7), F.lit(2))) == (2.0, 4.0, -2.0, -3)
    assert one(spark, scalar.scalar_min(F.lit(1), F.lit(None).cast("int")), F.least(F.lit(1), F.lit(None).cast("int")), scalar.log(F.lit(1000.0))) == (None, 1, pytest.approx(3))
    with pytest.raises(PySparkException):
        one(spark, F.lit(1) / F.lit(0))


def test_bits(spark):
    b = F.lit("1010")
    assert one(spark, scalar.bit_count(b), scalar.get_bit(b, 2), scalar.set_bit(b, 3, 1), scalar.bit_and(b, F.lit("1100")), scalar.bit_or(b, F.lit("1100"))) == (2, 1, "1011", "1000", "1110")
    with pytest.raises(PySparkException):
        one(spark, scalar.get_bit(b, 4))


@pytest.mark.parametrize(("text", "parts", "shown"), [
    ("1 year 2 months 3 days 04:05:06.5", (14, 3, 14_706_500_000), "1 year 2 mons 3 days 04:05:06.5"),
    ("1.5 days", (0, 1, 43_200_000_000), "1 day 12:00:00"),
    ("-1 month", (-1, 0, 0), "-1 mons"),
    ("2 hours ago", (0, 0, -7_200_000_000), "-02:00:00"),
    ("1 week", (0, 7, 0), "7 days"),
])
def test_intervals(spark, text, parts, shown):
    assert temporal.parse_interval(text) == parts
    assert one(spark, temporal.interval_text(temporal.interval_literal(text))) == (shown,)


def test_dates(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    show = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    assert one(spark, show(temporal.date_bin("15 minutes", at("1999-12-31 23:59:00"), at("2000-01-01 00:05:00"))))[0] == "1999-12-31 23:50:00"
    assert one(spark, show(temporal.add_interval(at("2024-01-31 10:00:00"), temporal.interval_literal("1 month 1 hour"))))[0] == "2024-02-29 11:00:00"
    a = one(spark, temporal.age(at("2024-03-01 00:00:00"), at("2024-01-31 12:00:00")))[0]
    b = one(spark, temporal.age(at("2024-01-31 12:00:00"), at("2024-03-01 00:00:00")))[0]
    assert tuple(a) == (1, 0, 43_200_000_000) and tuple(b) == (-1, 0, -43_200_000_000)
    assert one(spark, temporal.overlaps(at("2024-01-01"), at("2024-01-03"), at("2024-01-03"), at("2024-01-02")), temporal.overlaps(at("2024-01-01"), at("2024-01-02"), at("2024-01-02"), at("2024-01-03"))) == (True, False)
    with pytest.raises(ValueError):
        temporal.date_bin("1 month", at("2024-01-01"), at("2024-01-01"))


def test_arrays(spark):
    a, none = F.array(F.lit(1), F.lit(None), F.lit(3), F.lit(1)), F.lit(None).cast("int")
    c = collections
    assert one(spark, c.array_position(a, none), c.array_position(a, 9), c.array_position(a, 1, 2), c.array_positions(a, 1)) == (2, None, 4, [1, 4])
    assert one(spark, c.array_length(F.array().cast("array<int>")), c.array_replace(a, none, F.lit(0)), c.array_remove(a, none), c.subscript(a, 0), c.array_slice(a, 0, 2)) == (None, [1, 0, 3, 1], [1, 3, 1], None, [1, None])
    with pytest.raises(PySparkException):
        one(spark, c.trim_array(a, 5))


def test_ranges(spark):
    c, n = collections, F.lit(None).cast("int")
    r = lambda lo, hi, b="[)": c.make_range(F.lit(lo) if lo is not None else n, F.lit(hi) if hi is not None else n, b)
    assert one(spark, c.range_contains(r(1, 5), F.lit(5)), c.range_contains(r(1, 5, "[]"), F.lit(5)), c.range_contains(r(None, 5), F.lit(-9)), c.range_overlaps(r(1, 3), r(3, 5)), c.range_overlaps(r(1, 3, "[]"), r(3, 5)), c.range_contains_range(r(None, None), r(1, None)), c.range_contains_range(r(1, 9), r(1, None))) == (False, True, True, False, True, True, False)


DOC = '{"a": [1, 2, {"b": null}], "c": {"d": "x", "e": 5}, "s": "12"}'


@pytest.mark.parametrize(("path", "found"), [
    ("$.a[*]", [1, 2, {"b": None}]), ("$.a[0 to 1]", [1, 2]), ("$.a[last].b", [None]), ("$.c.*", ["x", 5]), ("$.**{2 to last}.d", []), ("$.**.d", ["x"]), ("$.a[*] ? (@ > 1)", [2]),
    ('$.c ? (@.d == "x" && @.e < 6).e', [5]), ("$.a.size()", [3]), ("$.a[*].type()", ["number", "number", "object"]), ("$.s.double() + 1", [13.0]), ("$.c.e > 4", [True]), ("-$.c.e", [-5]), ('$.c.d ? (@ like_regex "^X" flag "i")', ["x"]),
    ('$.c ? (exists(@.d)).d ? (@ starts with "x")', ["x"]), ("$.nothing", []), ("$.c.keyvalue().key", ["d", "e"]), ("$.a[0].x ? (@ is unknown)", []), ("$.a[*] ? (@.b == null).b", [None]), ("$x.y", [3]),
])
def test_json_paths(path, found):
    assert jsonpath.query(DOC, path, '{"x": {"y": 3}}') == found


def test_json_path_errors():
    for path in ("strict $.nothing", "$.a[*] + 1", "$.c.d / 0", "$z"):
        with pytest.raises(jsonpath.PathError):
            jsonpath.query(DOC, path)
    with pytest.raises(jsonpath.PathError):
        jsonpath.compiled("$.a[")


def test_json(spark):
    d = F.lit(DOC)
    assert one(spark, documents.json_get_text(d, "c", "d"), documents.json_get_text(d, "a", 1), documents.has_key(d, "a", "z"), documents.has_key(d, "a", "z", every=True), documents.json_contains(d, F.lit('{"c": {"e": 5}, "a": [2]}')), documents.json_contains(d, F.lit('{"c": {"e": 6}}'))) == ("x", "2", True, False, True, False)
    assert one(spark, documents.jsonb_set(F.lit('{"a": [1, 2]}'), ["a", "-1"], F.lit("9")), documents.jsonb_set(F.lit('{"a": 1}'), ["b"], F.lit("2"), create=False), documents.jsonb_set(F.lit('{"a": 1}'), ["b"], F.lit("2"))) == ('{"a":[1,9]}', '{"a":1}', '{"a":1,"b":2}')
    assert one(spark, documents.jsonb_path_query(d, "$.a[*] ? (@ > 0)"), documents.jsonb_path_exists(d, "$.c.d")) == (["1", "2"], True)


def test_casts(spark):
    assert one(spark, casts.to_boolean(F.lit("of")), casts.to_money(F.lit("($1,234.50)")), casts.enum_ordinal(F.lit("b"), ["a", "b"]), casts.bpchar_equal(F.lit("a  "), F.lit("a")))[0] is False
    assert tuple(one(spark, casts.timetz(F.lit("12:34:56.5+02:30")))[0]) == (45_296_500_000, 9000)
    for bad in (casts.to_boolean(F.lit("maybe")), casts.to_uuid(F.lit("123")), casts.domain(F.lit(-1), lambda x: x > 0, "positive")):
        with pytest.raises(PySparkException):
            one(spark, bad)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0))
    assert one(spark, search.l2_distance(a, b), search.l1_distance(a, b), search.inner_product(a, b), search.cosine_distance(a, b), search.hamming_distance(F.lit("1010"), F.lit("0011"))) == (5.0, 7.0, 0.0, 1.0, 2)
    with pytest.raises(PySparkException):
        one(spark, search.l2_distance(a, F.array(F.lit(1.0))))


def test_merge(spark):
    t = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "c")], "id int, v int, marker string")
    s = spark.createDataFrame([(1, 11, "upd"), (2, 0, "del"), (9, 90, "new")], "id int, v int, op string")
    clauses = [("matched", F.col("s.op") == "del", "delete"), ("matched", None, {"v": F.col("s.v")}), ("not matched", None, {"id": F.col("s.id"), "v": F.col("s.v"), "marker": F.lit("n")}), ("not matched by source", None, {"marker": F.lit("gone")})]
    assert sorted(map(tuple, relational.merge(t, s, ["id"], clauses).collect())) == [(1, 11, "a"), (3, 30, "gone"), (9, 90, "n")]
    with pytest.raises(PySparkException):
        relational.merge(t, s.unionAll(s), ["id"], clauses).collect()


def test_recursion_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    got = relational.recursive_union(spark, edges, lambda t: t.alias("t").join(edges.alias("e"), F.col("t.b") == F.col("e.a")).select("t.a", "e.b"))
    assert got.count() == 9


def test_exclude_frames(spark):
    df = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 2, 30), (4, 2, None)], "id int, k int, v int")
    w = Window.orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    got = windows.exclude_peers(windows.exclude_peers(df, "t", "v", "k", "id", w, True), "g", "v", "k", "id", w, False)
    assert sorted((r.id, r.t, r.g) for r in got.collect()) == [(1, 10, None), (2, 20, None), (3, 60, 30), (4, 30, 30)]


def test_summary_of_an_empty_table(spark):
    got = describe.summarize(spark.createDataFrame([], "a int, b string")).collect()
    assert [(r.column_name, r.row_count, r.unique_count) for r in got] == [("a", 0, 0), ("b", 0, 0)]


def test_rollup_falls_back_to_the_base(spark):
    df = spark.createDataFrame([(1, "x", 2), (1, "y", 4)], "t int, b string, v int")
    r = rollup.Rollup(("t",), (("sum", "v"),))
    assert not r.answers(["b"], [("sum", "v")]) and r.answers(["t"], [("sum", "v")])
    assert sorted(map(tuple, r.aggregate(r.build(df), df, ["b"], [("max", "v")]).collect())) == [("x", 2), ("y", 4)]


def test_hybrid_ties_and_missing_parts(spark):
    df = spark.createDataFrame([(1, "apple pie", [1.0, 0.0]), (2, "apple pie", [1.0, 0.0]), (3, None, [0.0, 1.0]), (4, "", None)], "id int, text string, v array<double>")
    got = retrieval.hybrid_search(df, "id", "text", "apple", "v", [1.0, 0.0], 4, "rrf").collect()
    assert [r.id for r in got] == [1, 2, 3, 4] and got[3].score == 0.0


def test_ivf_recall(spark, tmp_path):
    from tarn.operators import ivf

    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    index = ivf.IvfIndex.build(df, "embedding", str(tmp_path / "ivf"), 8)
    found = 0
    queries = [[float(x) for x in r[0]] for r in df.where("vec_id % 50 = 0").select("embedding").collect()]
    for q in queries:
        exact = {r.vec_id for r in retrieval.vector_top_k(df, "embedding", q, 10).collect()}
        found += len(exact & {r.vec_id for r in index.search(q, 10, 5).collect()})
    assert found / (10 * len(queries)) >= 0.9
