"""Catalogue, prepared statements, views, path queries and late materialization as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import documents
from tarn.operators import catalog, describe, relational
from tarn.plans.registry import query, sql_query, table


@query("catalog_columns", "SELECT column_name, ordinal_position::INT AS ordinal_position FROM information_schema.columns WHERE table_name = 'supplier'")
def catalog_columns(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("tarn_supplier")
    return catalog.columns(spark, "tarn_supplier").select("column_name", "ordinal_position")


@query("prepared_statement", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.0")
def prepared_statement(spark, sf_dir):
    p = catalog.Prepared(spark, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = :customer AND o_totalprice > :least", orders=table(spark, sf_dir, "orders"))
    return p.execute(customer=7, least=1000.0)


@query("view_and_subquery", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey HAVING count(*) > 3")
def view(spark, sf_dir):
    table(spark, sf_dir, "orders").where("o_totalprice > 100000").createOrReplaceTempView("tarn_large_orders")
    return spark.sql("SELECT o_custkey, count(*) AS n FROM tarn_large_orders GROUP BY o_custkey HAVING count(*) > 3")


@query("late_materialization", "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey LIMIT 5")
def late_materialization(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("__key", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return catalog.late_top_k(rows, "__key", relational.order("-l_extendedprice"), 5).drop("__key")


@query("jsonb_path_query", "SELECT event_id, (props->>'$.k') AS hit FROM events WHERE (props->>'$.k')::INT >= 30")
def jsonb_path_query(spark, sf_dir):
    hits = documents.jsonb_path_query(F.col("props"), "$.k ? (@ >= $least)", '{"least": 30}')
    return table(spark, sf_dir, "events").select("event_id", F.explode(hits).alias("hit"))


@query("session_facts", "SELECT true AS has_version, true AS has_user, true AS today_is_now")
def session_facts(spark, sf_dir):
    return catalog.session_facts(spark).select(F.col("version").isNotNull().alias("has_version"), F.col("current_user").isNotNull().alias("has_user"), (F.col("today") == F.to_date("now")).alias("today_is_now"))


@query("explain", "SELECT true AS filter_is_pushed")
def explain(spark, sf_dir):
    text = describe.explain(table(spark, sf_dir, "orders").where("o_orderkey < 10").select("o_custkey"))
    return spark.createDataFrame([("LessThan(o_orderkey,10)" in text,)], "filter_is_pushed boolean")


sql_query("agg_vector_avg", "SELECT label, p AS i, round(avg(CAST(x AS DOUBLE)), 5) AS a FROM {embeddings} LATERAL VIEW posexplode(embedding) v AS p, x GROUP BY label, p", "SELECT label, (i - 1)::INTEGER AS i, round(avg(embedding[i]::DOUBLE), 5) AS a FROM embeddings, range(1, 65) r(i) GROUP BY label, i", "embeddings")
sql_query("agg_over_join", "SELECT r_name, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM {region} JOIN {nation} ON n_regionkey = r_regionkey JOIN {customer} ON c_nationkey = n_nationkey LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY r_name", tables="region nation customer orders")
sql_query("agg_scalar_in_order_by", "SELECT o_orderpriority FROM {orders} GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 3", tables="orders")
sql_query("window_over_aggregate", "SELECT o_orderpriority, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, o_orderpriority) AS r FROM {orders} GROUP BY o_orderpriority", tables="orders")
sql_query("subquery_exists_or", "SELECT c_custkey FROM {customer} c WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c.c_custkey AND o_totalprice > 280000)", tables="customer orders")
sql_query("subquery_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n FROM {customer}", tables="customer orders")
sql_query("cte_chain", "WITH a AS (SELECT o_custkey, o_totalprice FROM {orders}), b AS (SELECT o_custkey, max(o_totalprice) AS top FROM a GROUP BY o_custkey) SELECT a.o_custkey, a.o_totalprice FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.o_totalprice = b.top", tables="orders")
sql_query("csv_like_group_by", "SELECT category, count(*) AS n, CAST(sum(metric) AS BIGINT) AS s FROM (SELECT p_brand AS category, p_size AS metric FROM {part}) GROUP BY category", tables="part")
sql_query("join_theta_band", "SELECT count(*) AS n FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal BETWEEN b.s_acctbal - 500 AND b.s_acctbal + 500", tables="supplier")
sql_query("join_nested_loop", "SELECT r_name, n_name FROM {region} JOIN {nation} ON n_nationkey > r_regionkey * 5 AND n_nationkey < r_regionkey * 5 + 3", tables="region nation")
sql_query("window_running_total", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS total FROM {events}", tables="events")
