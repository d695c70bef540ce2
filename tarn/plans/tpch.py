"""Decision-support queries over the star schema, limited to the columns that the tables have.

Dates are compared as DATE literals, which reach the scan as pushed filters on the timestamp columns.
"""

from __future__ import annotations

from tarn.plans.registry import sql_query

REVENUE = "l_extendedprice * (1 - l_discount)"


def exact(expression: str, scale: int = 4) -> str:
    """The sum of an expression that has so many decimals, as a decimal: the same in whatever order rows are added."""
    return f"CAST(sum(CAST(round({expression}, {scale}) AS DECIMAL(24, {scale}))) AS DOUBLE)"


sql_query("tpch_q1", f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       {exact(REVENUE)} AS sum_disc_price, {exact(REVENUE + ' * (1 + l_tax)', 6)} AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM {{lineitem}} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
""", tables="lineitem")  # fmt: skip

sql_query("tpch_q3", f"""
SELECT l_orderkey, {exact(REVENUE)} AS revenue, o_orderdate
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC NULLS FIRST, o_orderdate, l_orderkey LIMIT 10
""", tables="customer orders lineitem")  # fmt: skip

sql_query("tpch_q4", """
SELECT o_orderpriority, count(*) AS order_count FROM {orders}
WHERE o_orderdate >= DATE '1993-07-01' AND o_orderdate < DATE '1996-10-01' AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_quantity > 30)
GROUP BY o_orderpriority ORDER BY o_orderpriority
""", tables="orders lineitem")  # fmt: skip

sql_query("tpch_q5", f"""
SELECT n_name, {exact(REVENUE)} AS revenue
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
     JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1994-01-01' AND o_orderdate < DATE '1995-01-01'
GROUP BY n_name ORDER BY revenue DESC
""", tables="customer orders lineitem supplier nation region")  # fmt: skip

sql_query("tpch_q6", """
SELECT CAST(sum(CAST(round(l_extendedprice * l_discount, 4) AS DECIMAL(24, 4))) AS DOUBLE) AS revenue FROM {lineitem}
WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24
""", tables="lineitem")  # fmt: skip

sql_query("tpch_q7", f"""
WITH shipping AS (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year, {REVENUE} AS volume
  FROM {{supplier}} JOIN {{lineitem}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{customer}} ON c_custkey = o_custkey
       JOIN {{nation}} n1 ON s_nationkey = n1.n_nationkey JOIN {{nation}} n2 ON c_nationkey = n2.n_nationkey
  WHERE n1.n_regionkey = 1 AND n2.n_regionkey = 2 AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31')
SELECT supp_nation, cust_nation, CAST(l_year AS INT) AS l_year, {exact('volume')} AS revenue FROM shipping GROUP BY supp_nation, cust_nation, l_year
""", tables="supplier lineitem orders customer nation")  # fmt: skip

sql_query("tpch_q8", f"""
WITH all_nations AS (
  SELECT year(o_orderdate) AS o_year, {REVENUE} AS volume, n2.n_name AS nation
  FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{orders}} ON l_orderkey = o_orderkey
       JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} n1 ON c_nationkey = n1.n_nationkey JOIN {{nation}} n2 ON s_nationkey = n2.n_nationkey
       JOIN {{region}} ON n1.n_regionkey = r_regionkey
  WHERE r_name = 'AMERICA' AND p_size < 25)
SELECT CAST(o_year AS INT) AS o_year, round(sum(CASE WHEN nation < 'J' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM all_nations GROUP BY o_year
""", tables="part lineitem supplier orders customer nation region")  # fmt: skip

sql_query("tpch_q9", f"""
SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year, {exact(REVENUE + ' - 0.1 * p_retailprice * l_quantity')} AS sum_profit
FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{nation}} ON s_nationkey = n_nationkey
WHERE p_brand LIKE '%1%' GROUP BY n_name, year(o_orderdate)
""", tables="part lineitem supplier orders nation")  # fmt: skip

sql_query("tpch_q10", f"""
SELECT c_custkey, c_name, {exact(REVENUE)} AS revenue, c_acctbal, n_name
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{nation}} ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '1993-10-01' AND o_orderdate < DATE '1994-04-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20
""", tables="customer orders lineitem nation")  # fmt: skip

sql_query("tpch_q12", """
SELECT l_returnflag, count(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 END) AS high_line_count, count(CASE WHEN o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%' THEN 1 END) AS low_line_count
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' GROUP BY l_returnflag
""", tables="orders lineitem")  # fmt: skip

sql_query("tpch_q13", """
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders GROUP BY c_count
""", tables="customer orders")  # fmt: skip

sql_query("tpch_q14", f"""
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1996-10-01'
""", tables="lineitem part")  # fmt: skip

sql_query("tpch_q15", f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, {exact(REVENUE)} AS total_revenue FROM {{lineitem}} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {{supplier}} JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)
""", tables="lineitem supplier")  # fmt: skip

sql_query("tpch_q17", """
SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE p_size < 20 AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM {lineitem} l2 WHERE l2.l_partkey = p_partkey)
""", tables="lineitem part")  # fmt: skip

sql_query("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""", tables="customer orders lineitem")  # fmt: skip

sql_query("tpch_q19", f"""
SELECT {exact(REVENUE)} AS revenue FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey
WHERE (p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 6 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 11 AND 15 AND l_quantity BETWEEN 20 AND 30)
""", tables="lineitem part")  # fmt: skip

sql_query("tpch_q22", """
SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM {customer} c
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c.c_custkey AND o_totalprice > 300000) GROUP BY c_nationkey
""", tables="customer orders")  # fmt: skip
