"""Scans, filters, joins, aggregates, sorts, set operations, subqueries and common table expressions as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import relational
from tarn.plans.registry import query, sql_query, table

# Scans and projections -------------------------------------------------------------------------------------------------
sql_query("scan_projection", "SELECT o_orderkey, o_totalprice FROM {orders}", tables="orders")
sql_query("scan_range_filter", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderkey BETWEEN 100 AND 900 AND o_orderstatus = 'F'", tables="orders")
sql_query("values_scan", "SELECT col1 AS a, col2 AS b FROM VALUES (1, 'one'), (2, 'two'), (3, NULL)", "SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) t(a, b)")
sql_query("result_without_from", "SELECT 1 + 2 AS three, 'x' AS x, CAST(NULL AS INT) AS nothing")
sql_query("empty_relation", "SELECT o_orderkey FROM {orders} WHERE 1 = 0", tables="orders")
sql_query("scan_sum", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s FROM {lineitem}", tables="lineitem")
sql_query("scan_avg", "SELECT round(avg(l_quantity), 8) AS a FROM {lineitem}", tables="lineitem")
sql_query("scan_filter_sum", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s FROM {lineitem} WHERE l_linenumber > 3 AND l_quantity < 30", tables="lineitem")

# Predicates ------------------------------------------------------------------------------------------------------------
sql_query("predicate_three_valued", """
SELECT a, b, a AND b AS both, a OR b AS either, NOT a AS neither, a IS NULL AS a_null, a IS TRUE AS a_true, a IS NOT FALSE AS a_not_false, a IS DISTINCT FROM b AS differ, a IS NOT DISTINCT FROM b AS same
FROM (SELECT * FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) x(a)) CROSS JOIN (SELECT * FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) y(b))
""")  # fmt: skip
sql_query("predicate_arithmetic", """
SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS plus, l_linenumber - 10 AS minus, l_linenumber * 3 AS times, CAST(l_orderkey div 7 AS BIGINT) AS quotient, l_orderkey % 7 AS remainder, -l_linenumber AS negated, CAST(power(l_linenumber, 2) AS DOUBLE) AS squared
FROM {lineitem}""", """
SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS plus, l_linenumber - 10 AS minus, l_linenumber * 3 AS times, l_orderkey // 7 AS quotient, l_orderkey % 7 AS remainder, -l_linenumber AS negated, power(l_linenumber, 2) AS squared FROM lineitem""", "lineitem")  # fmt: skip
sql_query("predicate_comparison", "SELECT count(*) AS n FROM {part} WHERE p_size = 5 OR p_size <> 7 AND p_retailprice >= 950.5 AND p_size <= 40 OR p_name < 'b'", tables="part")
sql_query("predicate_like", "SELECT p_partkey, p_type LIKE '%BRASS' AS a, p_type NOT LIKE 'S%' AS b, p_type ILIKE '%brass%' AS c, p_name LIKE '_a%' AS d FROM {part}", tables="part")
sql_query("predicate_regex", "SELECT p_partkey, p_type RLIKE '^(STANDARD|SMALL)' AS a, p_type RLIKE '(?i)brass$' AS b, NOT (p_type RLIKE 'TIN') AS c FROM {part}", "SELECT p_partkey, regexp_matches(p_type, '^(STANDARD|SMALL)') AS a, regexp_matches(p_type, '(?i)brass$') AS b, NOT regexp_matches(p_type, 'TIN') AS c FROM part", "part")
sql_query("predicate_bitwise", "SELECT p_partkey, p_size & 6 AS a, p_size | 9 AS o, p_size ^ 5 AS x, shiftleft(p_size, 2) AS l, shiftright(p_size, 1) AS r, ~p_size AS n FROM {part}", "SELECT p_partkey, p_size & 6 AS a, p_size | 9 AS o, xor(p_size, 5) AS x, p_size << 2 AS l, p_size >> 1 AS r, ~p_size AS n FROM part", "part")
sql_query("predicate_between_symmetric", "SELECT p_partkey FROM {part} WHERE p_size BETWEEN least(30, 10) AND greatest(30, 10) AND p_retailprice NOT BETWEEN 1000 AND 1100", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice NOT BETWEEN 1000 AND 1100", "part")
sql_query("predicate_in_list", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (1, 2, 3)", tables="orders")
sql_query("predicate_conditional", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code,
  coalesce(nullif(o_orderstatus, 'F'), 'was F') AS c, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l FROM {orders}""", tables="orders")  # fmt: skip

# Joins -----------------------------------------------------------------------------------------------------------------
sql_query("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > 150000", tables="orders customer")
sql_query("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'P'", tables="customer orders")
sql_query("join_right", "SELECT o_orderkey, c_custkey FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey AND o_totalprice > 250000", tables="orders customer")
sql_query("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM {supplier} WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM {customer} WHERE c_acctbal > 5000) c ON s_suppkey = c_custkey", tables="supplier customer")
sql_query("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}", tables="region nation")
sql_query("join_multi_key_residual", "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber", tables="lineitem")
sql_query("join_using_natural", "SELECT n_regionkey, n_name, r_name FROM {nation} JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM {region}) r USING (n_regionkey)", tables="nation region")
sql_query("join_natural", "SELECT n_regionkey, n_name, r_name FROM {nation} NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM {region}) r", tables="nation region")
sql_query("join_semi_exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)", tables="customer orders")
sql_query("join_semi_in", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)", tables="part lineitem")
sql_query("join_any_subquery", "SELECT p_partkey FROM {part} LEFT SEMI JOIN (SELECT l_partkey FROM {lineitem} WHERE l_discount > 0.08) q ON p_partkey = l_partkey", "SELECT p_partkey FROM part WHERE p_partkey = ANY (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)", "part lineitem")
sql_query("join_anti_not_exists", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)", tables="customer orders")
sql_query("join_anti_not_in", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_custkey IS NOT NULL)", tables="customer orders")
sql_query("join_not_in_null_aware", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT CASE WHEN o_custkey > 5 THEN o_custkey END FROM {orders})", tables="customer orders")
sql_query("join_null_keys", "SELECT a.k, b.v FROM (SELECT * FROM (VALUES (1), (2), (CAST(NULL AS INT))) a(k)) a LEFT JOIN (SELECT * FROM (VALUES (1, 'x'), (CAST(NULL AS INT), 'n')) b(k, v)) b ON a.k = b.k")
sql_query("join_lateral", "SELECT c_custkey, o_orderkey, o_totalprice FROM {customer} c, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t", tables="customer orders")

# Aggregates ------------------------------------------------------------------------------------------------------------
sql_query("agg_hash", "SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM {lineitem} GROUP BY l_suppkey", tables="lineitem")
sql_query("agg_having_positional", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1 HAVING count(*) > 5 ORDER BY 2 DESC NULLS FIRST, 1", tables="orders")
sql_query("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey % 10) AS BIGINT) AS s FROM {orders} GROUP BY o_orderstatus", tables="orders")
sql_query("agg_bool", "SELECT o_custkey, bool_and(o_totalprice > 50000) AS every_one, bool_or(o_totalprice > 200000) AS any_one FROM {orders} GROUP BY o_custkey", tables="orders")
sql_query("agg_string", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "nation")
sql_query("agg_array", "SELECT n_regionkey, sort_array(array_agg(n_nationkey)) AS keys FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, list_sort(array_agg(n_nationkey)) AS keys FROM nation GROUP BY n_regionkey", "nation")
sql_query("agg_array_empty_is_null", "SELECT CASE WHEN count(x) > 0 THEN array_join(sort_array(array_agg(x)), ',') END AS a, count(*) AS n FROM (SELECT CAST(NULL AS INT) AS x FROM {region})", "SELECT CAST(NULL AS VARCHAR) AS a, count(*) AS n FROM region", "region")
sql_query("agg_json", "SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS j FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, replace(CAST(to_json(list_sort(array_agg(n_nationkey))) AS VARCHAR), ' ', '') AS j FROM nation GROUP BY n_regionkey", "nation")
sql_query("agg_statistics", """
SELECT l_returnflag, round(stddev(l_quantity), 8) AS sd, round(stddev_pop(l_quantity), 8) AS sdp, round(variance(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 8) AS c
FROM {lineitem} GROUP BY l_returnflag""", tables="lineitem")  # fmt: skip
sql_query("agg_statistics_of_one", "SELECT r_regionkey, stddev_samp(CAST(r_regionkey AS DOUBLE)) AS sd, var_samp(CAST(r_regionkey AS DOUBLE)) AS v FROM {region} GROUP BY r_regionkey", tables="region")


@query("agg_percentiles", """
SELECT l_linestatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity), 8) AS q1, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 6) AS p90, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS med
FROM lineitem GROUP BY l_linestatus""")  # fmt: skip
def agg_percentiles(spark, sf_dir):
    """Spark's own percentiles gather a map of all values of a group in one task."""
    cuts = {"q1": ("cont", "l_quantity", 0.25), "p90": ("cont", "l_extendedprice", 0.9), "med": ("disc", "l_extendedprice", 0.5)}
    found = relational.quantiles(table(spark, sf_dir, "lineitem"), ["l_linestatus"], cuts)
    return found.select("l_linestatus", F.round("q1", 8).alias("q1"), F.round("p90", 6).alias("p90"), "med")


sql_query("agg_empty_input", "SELECT count(*) AS n, max(o_totalprice) AS m, CAST(sum(o_custkey) AS BIGINT) AS s FROM {orders} WHERE o_orderkey < 0", tables="orders")
sql_query("agg_vector_sum", "SELECT label, posexplode.pos AS i, round(sum(CAST(posexplode.col AS DOUBLE)), 4) AS s FROM {embeddings} LATERAL VIEW posexplode(embedding) posexplode AS pos, col GROUP BY label, posexplode.pos", "SELECT label, (i - 1)::INTEGER AS i, round(sum(embedding[i]::DOUBLE), 4) AS s FROM embeddings, range(1, 65) r(i) GROUP BY label, i", "embeddings")
sql_query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}", tables="lineitem")

# Windows ---------------------------------------------------------------------------------------------------------------
sql_query("window_ranking", """
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d, ntile(4) OVER w AS t
FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey)""", tables="orders")  # fmt: skip
sql_query("window_offsets", """
SELECT o_orderkey, lag(o_orderkey) OVER w AS a, lag(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER w AS b, lead(o_orderkey, 1) OVER w AS c, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n
FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""", tables="orders")  # fmt: skip
sql_query("window_rows_frame", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n, min(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM {lineitem}", tables="lineitem")
sql_query("window_range_frame", "SELECT p_partkey, p_size, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size) AS running FROM {part}", tables="part")
sql_query("window_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM {events}", tables="events")
sql_query("window_whole_partition", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 10) AS share, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM {orders}", tables="orders")

# Sorts, limits, set operations -----------------------------------------------------------------------------------------
sql_query("sort_null_order", "SELECT k FROM (SELECT CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey FROM {orders}) ORDER BY k ASC NULLS LAST, o_orderkey", tables="orders")
sql_query("sort_desc_nulls_first", "SELECT k, o_orderkey FROM (SELECT CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey FROM {orders}) ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 25", tables="orders")
sql_query("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15", tables="lineitem")
sql_query("limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 20 OFFSET 30", tables="orders")
sql_query("sort_hidden_key", "SELECT upper(p_name) AS n FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 12", tables="part")
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql_query(f"setop_{_name}", f"SELECT o_custkey % 50 AS k FROM {{orders}} {_op} SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 60 END FROM {{customer}}", tables="orders customer")
sql_query("setop_precedence", "SELECT 1 AS x UNION SELECT 2 INTERSECT SELECT 2 EXCEPT SELECT 1")
sql_query("setop_null_equality", "SELECT CAST(NULL AS INT) AS x INTERSECT SELECT CAST(NULL AS INT)")

# Common table expressions and subqueries -------------------------------------------------------------------------------
sql_query("cte_reused", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM big a WHERE a.n > (SELECT avg(n) FROM big)", tables="orders")
sql_query("cte_recursive_union_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql_query("subquery_scalar_correlated", "SELECT o_orderkey, (SELECT c_name FROM {customer} WHERE c_custkey = o_custkey) AS name FROM {orders} WHERE o_totalprice > (SELECT avg(o2.o_totalprice) FROM {orders} o2 WHERE o2.o_custkey = {orders}.o_custkey)".replace("{orders}.o_custkey", "o.o_custkey").replace("FROM {orders} WHERE", "FROM {orders} o WHERE"), tables="orders customer")
sql_query("subquery_scalar_empty", "SELECT r_name, (SELECT n_name FROM {nation} WHERE n_nationkey = -1) AS nothing FROM {region}", tables="region nation")
sql_query("subquery_in_from", "SELECT q.status, q.n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY o_orderstatus) q WHERE q.n > 10", tables="orders")
