"""Operators of the library as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.operators import describe, ivf, relational, retrieval, rollup, windows
from tarn.plans.registry import ORACLES, query, sql_query, table
from tarn.workspace import Workspace


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.distinct_on(rows, ["o_custkey"], relational.order("-o_totalprice", "o_orderkey"))


@query("pivot", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey")
def pivot(spark, sf_dir):
    return relational.pivot(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"], {"n": F.count(F.lit(1))}, ["o_custkey"])


@query("pivot_many", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F_s, max(l_linenumber) FILTER (l_linestatus = 'F') AS F_m, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O_s, max(l_linenumber) FILTER (l_linestatus = 'O') AS O_m FROM lineitem GROUP BY l_returnflag")
def pivot_many(spark, sf_dir):
    return relational.pivot(table(spark, sf_dir, "lineitem"), "l_linestatus", ["F", "O"], {"s": F.round(F.sum("l_quantity"), 2), "m": F.max("l_linenumber")}, ["l_returnflag"])


@query("unpivot", "SELECT p_partkey, name, value FROM (UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS p_size, CASE WHEN p_size > 10 THEN p_retailprice END AS price FROM part) ON p_size, price INTO NAME name VALUE value)")
def unpivot(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"))
    return relational.unpivot(rows, ["p_size", "price"], "name", "value")


@query("unpivot_include_nulls", "SELECT p_partkey, 'p_size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', CASE WHEN p_size > 10 THEN p_retailprice END FROM part")
def unpivot_include_nulls(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"))
    return relational.unpivot(rows, ["p_size", "price"], "name", "value", include_nulls=True)


sql_query("pivot_sql", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}) PIVOT (max(l_linenumber) FOR l_linestatus IN ('F' AS f, 'O' AS o))", "SELECT l_returnflag, max(l_linenumber) FILTER (l_linestatus = 'F') AS f, max(l_linenumber) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag", "lineitem")


@query("recursive_union", "WITH RECURSIVE t(a, b) AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation UNION SELECT t.a, (t.b * 2 + 1) % 7 FROM t) SELECT a, b FROM t")
def recursive_union(spark, sf_dir):
    start = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"))
    return relational.recursive_union(spark, start, lambda t: t.select("a", (F.col("b") * 2 + 1) % 7))


@query("merge", """
WITH s AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v, count(*) AS n FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey UNION ALL SELECT 10000000 + r_regionkey, 1.0, 1 FROM region)
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'new' WHEN k IS NULL THEN c_name ELSE 'changed' END AS c_name, CASE WHEN k IS NULL THEN c_acctbal ELSE v END AS c_acctbal
FROM customer FULL JOIN s ON c_custkey = k WHERE NOT (c_custkey IS NOT NULL AND k IS NOT NULL AND n > 12)""")  # fmt: skip
def merge(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    sums = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count("*").alias("n"))
    source = sums.unionAll(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long") + 10000000, F.lit(1.0), F.lit(1).cast("long")))
    return relational.merge(target, source, ["c_custkey"], [
        ("matched", F.col("s.n") > 12, "delete"),
        ("matched", None, {"c_name": F.lit("changed"), "c_acctbal": F.col("s.v")}),
        ("not matched", None, {"c_custkey": F.col("s.c_custkey"), "c_name": F.lit("new"), "c_acctbal": F.col("s.v")}),
    ])


@query("upsert", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 'again' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 50000000, 'again' FROM customer WHERE c_custkey % 2 = 0")
def upsert(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    even = target.where("c_custkey % 2 = 0").withColumn("c_name", F.lit("again"))
    return relational.upsert(target, even.unionAll(even.withColumn("c_custkey", F.col("c_custkey") + 50000000)), ["c_custkey"])


@query("upsert_values", "SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN '+' || (c_acctbal + 1)::VARCHAR ELSE '' END AS c_name, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS c_acctbal FROM customer")
def upsert_values(spark, sf_dir):
    """DO UPDATE SET with expressions of the row that is there and of the new one."""
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = target.where("c_custkey % 3 = 0").select("c_custkey", F.lit("+").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return relational.upsert(target, new, ["c_custkey"], values={"c_name": F.concat("t.c_name", "s.c_name", F.col("s.c_acctbal").cast("string")), "c_acctbal": F.col("s.c_acctbal")})


@query("upsert_returning", "SELECT c_custkey, 'new' AS c_name FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 50000000, 'new' FROM customer WHERE c_custkey % 5 = 1")
def upsert_returning(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    fifth = lambda n: target.where(f"c_custkey % 5 = {n}").select("c_custkey", F.lit("new").alias("c_name"))
    return relational.upsert(target, fifth(0).unionAll(fifth(1).withColumn("c_custkey", F.col("c_custkey") + 50000000)), ["c_custkey"], returning=True)


@query("upsert_repeated_keys", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_nationkey + 50000000, min(c_name) FROM customer GROUP BY c_nationkey")
def upsert_repeated_keys(spark, sf_dir):
    """DO NOTHING keeps the first of new rows with one key."""
    rows = table(spark, sf_dir, "customer")
    new = rows.select((F.col("c_nationkey") + 50000000).cast("long").alias("c_custkey"), "c_name")
    return relational.upsert(rows.select("c_custkey", "c_name"), new, ["c_custkey"], update=False, order=[F.col("c_name")])


@query("upsert_do_nothing", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 50000000, 'again' FROM customer")
def upsert_do_nothing(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    again = target.withColumn("c_name", F.lit("again"))
    return relational.upsert(target, again.unionAll(again.withColumn("c_custkey", F.col("c_custkey") + 50000000)), ["c_custkey"], update=False)


@query("update_delete", "SELECT p_partkey, CASE WHEN p_size > 30 THEN 0 ELSE p_size END AS p_size FROM part WHERE NOT p_retailprice < 950")
def update_delete(spark, sf_dir):
    rows = relational.delete(table(spark, sf_dir, "part"), F.col("p_retailprice") < 950)
    return relational.update(rows, F.col("p_size") > 30, {"p_size": F.lit(0)}).select("p_partkey", "p_size")


@query("generate_series", "SELECT generate_series FROM generate_series(10, -5, -3) t(generate_series)")
def generate_series(spark, sf_dir):
    return relational.generate_series(spark, 10, -5, -3)


@query("unnest", "SELECT vec_id, unnest(embedding)::FLOAT AS x FROM embeddings")
def unnest(spark, sf_dir):
    return relational.unnest(table(spark, sf_dir, "embeddings"), F.col("embedding"), "x").select("vec_id", "x")


@query("json_each", "SELECT event_id, j.key, j.value::VARCHAR AS value FROM events, json_each(props) j")
def json_each(spark, sf_dir):
    return relational.json_each(table(spark, sf_dir, "events"), "props").select("event_id", "key", "value")


@query("row_security", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def row_security(spark, sf_dir):
    return relational.tenant_view(table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING").agg(F.count("*").alias("n"))


@query("sequence", "SELECT n_nationkey, 100 + 5 * (row_number() OVER (ORDER BY n_name) - 1) AS id FROM nation")
def sequence(spark, sf_dir):
    return relational.numbered(table(spark, sf_dir, "nation"), "id", 100, 5, relational.order("n_name")).select("n_nationkey", "id")


@query("window_groups_frame", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(l_linenumber) OVER (PARTITION BY l_suppkey % 50 ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM lineitem")
def window_groups_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_suppkey") % 50)
    return windows.groups_frame(rows, "s", F.sum("l_linenumber"), ["p"], relational.order("l_quantity"), 1, 1).select("l_orderkey", "l_linenumber", "l_partkey", "s")


@query("window_exclude_current", "SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER w AS s, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)")
def window_exclude_current(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 2)
    v = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", windows.exclude_current_sum(v, w).cast("decimal(38,2)").alias("s"), windows.exclude_current_count(F.lit(1), w).alias("n"))


@query("window_exclude_ties", """
SELECT o_orderkey, CAST(sum(o_shift) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS BIGINT) AS ties,
  CAST(max(o_shift) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS BIGINT) AS grp FROM (SELECT *, o_orderkey % 1000 AS o_shift FROM orders) q""")  # fmt: skip
def window_exclude_ties(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("o_shift", F.col("o_orderkey") % 1000)
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = windows.exclude_peers(rows, "ties", "o_shift", "o_orderpriority", "o_orderkey", w, True)
    return windows.exclude_peers(rows, "grp", "o_shift", "o_orderpriority", "o_orderkey", w, False, "max").select("o_orderkey", "ties", "grp")


@query("describe", "SELECT column_name, row_number() OVER ()::INT AS ordinal FROM (DESCRIBE part)")
def describe_query(spark, sf_dir):
    return describe.describe(table(spark, sf_dir, "part")).select("column_name", "ordinal")


@query("summarize", """
SELECT 'p_partkey' AS column_name, count(*) AS row_count, count(*) - count(p_partkey) AS null_count, min(p_partkey)::VARCHAR AS min, max(p_partkey)::VARCHAR AS max, count(DISTINCT p_partkey) AS unique_count, round(avg(p_partkey), 6) AS avg, round(stddev(p_partkey), 6) AS stddev FROM part
UNION ALL SELECT 'p_brand', count(*), count(*) - count(p_brand), min(p_brand), max(p_brand), count(DISTINCT p_brand), NULL, NULL FROM part
UNION ALL SELECT 'p_size', count(*), count(*) - count(p_size), min(p_size)::VARCHAR, max(p_size)::VARCHAR, count(DISTINCT p_size), round(avg(p_size), 6), round(stddev(p_size), 6) FROM part""")  # fmt: skip
def summarize(spark, sf_dir):
    out = describe.summarize(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"))
    return out.withColumn("avg", F.round("avg", 6)).withColumn("stddev", F.round("stddev", 6))


EVENTS = rollup.Rollup(("event_type", "day"), (("count", "*"), ("sum", "value"), ("min", "value"), ("max", "value"), ("avg", "value")))


@query("aggregating_index", "SELECT event_type, count(*) AS count_all, round(sum(value), 4) AS sum_value, max(value) AS max_value, round(avg(value), 6) AS avg_value FROM events WHERE ts::DATE >= DATE '2024-01-05' GROUP BY event_type")
def aggregating_index(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    index = EVENTS.refresh(EVENTS.build(rows.where("event_id % 2 = 0")), rows.where("event_id % 2 = 1"))
    out = EVENTS.aggregate(index, rows, ["event_type"], [("count", "*"), ("sum", "value"), ("max", "value"), ("avg", "value")], F.col("day") >= "2024-01-05")
    return out.withColumn("sum_value", F.round("sum_value", 4)).withColumn("avg_value", F.round("avg_value", 6))


def _probe(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()[0]]


@query("vector_topk", "SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 10")
def vector_topk(spark, sf_dir):
    out = retrieval.vector_top_k(table(spark, sf_dir, "embeddings"), "embedding", _probe(spark, sf_dir), 10, ties="vec_id")
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


@query("vector_topk_filtered", "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS distance FROM embeddings WHERE label = 3 ORDER BY 2, 1 LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    out = retrieval.vector_top_k(table(spark, sf_dir, "embeddings"), "embedding", _probe(spark, sf_dir), 10, "cosine", F.col("label") == 3, "vec_id")
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


BM25 = """
d AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS v FROM documents WHERE lang = 'en'),
c AS (SELECT doc_id, len(v) AS dl, len(list_filter(v, lambda x: x = 'onion')) AS t0, len(list_filter(v, lambda x: x = 'which')) AS t1, len(list_filter(v, lambda x: x = 'ther')) AS t2 FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS al, sum((t0 > 0)::INT) AS d0, sum((t1 > 0)::INT) AS d1, sum((t2 > 0)::INT) AS d2 FROM c),
b AS (SELECT doc_id, ln((n - d0 + 0.5) / (d0 + 0.5) + 1) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / al)) + ln((n - d1 + 0.5) / (d1 + 0.5) + 1) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / al)) + ln((n - d2 + 0.5) / (d2 + 0.5) + 1) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * dl / al)) AS bm25 FROM c, s),
h AS (SELECT doc_id, bm25, 1 / (1 + list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))) AS similarity FROM b JOIN embeddings ON doc_id = vec_id)
"""


HYBRID = BM25.replace("FROM documents WHERE lang = 'en'", "FROM documents WHERE lang = 'en' AND doc_id IN (SELECT vec_id FROM embeddings)")


@query("bm25_english", f"WITH {BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM b WHERE bm25 > 0")
def bm25_english(spark, sf_dir):
    """A filter before scoring: other languages count in no statistic."""
    return retrieval.bm25(table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id", "text", "Onion which ther").select("doc_id", F.round("bm25", 6).alias("bm25"))


WHOLE = BM25.replace(" WHERE lang = 'en'", "")


@query("bm25", f"WITH {WHOLE} SELECT doc_id, round(bm25, 6) AS bm25 FROM b WHERE bm25 > 0")
def bm25(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", "Onion which ther").select("doc_id", F.round("bm25", 6).alias("bm25"))


def _candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(rows, "doc_id", "left").where("embedding IS NOT NULL")


WHOLE_HYBRID = HYBRID.replace("lang = 'en' AND ", "")


@query("hybrid_weighted", f"WITH {WHOLE_HYBRID} SELECT doc_id, round(bm25 + similarity, 6) AS score FROM h ORDER BY bm25 + similarity DESC, doc_id LIMIT 20")
def hybrid_weighted(spark, sf_dir):
    out = retrieval.hybrid_search(_candidates(spark, sf_dir), "doc_id", "text", "onion which ther", "embedding", _probe(spark, sf_dir), 20)
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query("hybrid_rrf", f"WITH {WHOLE_HYBRID}, r AS (SELECT doc_id, CASE WHEN bm25 > 0 THEN 1.0 / (60 + row_number() OVER (ORDER BY CASE WHEN bm25 > 0 THEN bm25 END DESC NULLS LAST, doc_id)) ELSE 0 END + 1.0 / (60 + row_number() OVER (ORDER BY similarity DESC, doc_id)) AS score FROM h) SELECT doc_id, round(score, 8) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 20")
def hybrid_rrf(spark, sf_dir):
    out = retrieval.hybrid_search(_candidates(spark, sf_dir), "doc_id", "text", "onion which ther", "embedding", _probe(spark, sf_dir), 20, "rrf")
    return out.select("doc_id", F.round("score", 8).alias("score"))


@query("vector_ivf_all_lists", ORACLES["vector_topk"])
def vector_ivf_all_lists(spark, sf_dir):
    """With every list probed, the index is exact; the tests measure recall with fewer."""
    index = ivf.IvfIndex.build(table(spark, sf_dir, "embeddings"), "embedding", Workspace(spark, "ivf").path("index"), 8)
    return index.search(_probe(spark, sf_dir), 10, 8, ties="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))
