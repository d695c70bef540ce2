"""Scalar functions as queries: each group over a table, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import casts, collections, documents, scalar, search, temporal
from tarn.plans.registry import query, table


@query("fn_conditional", """
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, o_orderstatus IS DISTINCT FROM 'F' AS b, (o_totalprice > 100000) IS TRUE AS c, (o_totalprice > 100000) IS NOT TRUE AS d,
  (o_totalprice > 100000) IS FALSE AS e, greatest(o_orderkey, NULL, o_custkey) AS g, least(o_orderkey, o_custkey) AS l, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE least(o_orderkey, o_custkey) END AS m
FROM orders""")  # fmt: skip
def conditional(spark, sf_dir):
    k, c, high = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice") > 100000
    nothing = F.lit(None).cast("long")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        scalar.nvl(scalar.nullif(F.col("o_orderstatus"), "F"), "none").alias("a"),
        scalar.is_distinct_from(F.col("o_orderstatus"), F.lit("F")).alias("b"),
        scalar.is_true(high).alias("c"),
        scalar.is_true(high, negated=True).alias("d"),
        scalar.is_true(high, want=False).alias("e"),
        F.greatest(k, nothing, c).alias("g"),
        F.least(k, c).alias("l"),
        scalar.scalar_min(k, F.when(c % 2 != 0, c)).alias("m"),
    )


@query("fn_math", """
SELECT o_orderkey, abs(x) AS a, ceil(x) AS c, floor(x) AS f, round_even(x * 2, 0) AS r, trunc(x) AS t, o_orderkey % 7 AS m, power(2.0, o_orderkey % 10) AS p, round(sqrt(abs(x)), 8) AS s, round(exp(sin(x)), 8) AS e,
  round(ln(o_totalprice), 8) AS n, round(log10(o_totalprice), 8) AS g, round(log2(o_totalprice), 8) AS g2, round(sin(x) + cos(x) + tan(x / 1e6), 6) AS trig, round(asin(y) + acos(y) + atan(y), 8) AS arc, round(pi(), 10) AS pi, CAST(sign(x) AS INT) AS sg
FROM (SELECT *, o_totalprice / 1000 - 150 AS x, (o_orderkey % 100) / 100.0::DOUBLE AS y FROM orders) q""")  # fmt: skip
def math(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("x", F.col("o_totalprice") / 1000 - 150).withColumn("y", (F.col("o_orderkey") % 100) / F.lit(100.0))
    x, y, p, k = F.col("x"), F.col("y"), F.col("o_totalprice"), F.col("o_orderkey")
    return rows.select(
        "o_orderkey",
        F.abs(x).alias("a"),
        F.ceil(x).cast("double").alias("c"),
        F.floor(x).cast("double").alias("f"),
        scalar.round_double(x * 2).alias("r"),
        scalar.truncate(x).alias("t"),
        (k % 7).alias("m"),
        F.pow(F.lit(2.0), k % 10).alias("p"),
        F.round(F.sqrt(F.abs(x)), 8).alias("s"),
        F.round(F.exp(F.sin(x)), 8).alias("e"),
        F.round(F.ln(p), 8).alias("n"),
        F.round(scalar.log(p), 8).alias("g"),
        F.round(scalar.log(p, F.lit(2.0)), 8).alias("g2"),
        F.round(F.sin(x) + F.cos(x) + F.tan(x / 1e6), 6).alias("trig"),
        F.round(F.asin(y) + F.acos(y) + F.atan(y), 8).alias("arc"),
        F.round(F.pi(), 10).alias("pi"),
        F.signum(x).cast("int").alias("sg"),
    )


@query("fn_string", r"""
SELECT p_partkey, length(p_name) AS a, bit_length(p_name) AS b, octet_length(encode(p_name)) AS c, lower(p_type) AS d, upper(p_name) AS e, trim(chr(9) || '  ' || p_name || ' ' || chr(10), chr(9) || chr(10) || ' ') AS f,
  lpad(p_name, 12, '*') AS g, rpad(p_name, 12, 'xy') AS h, left(p_type, -3) AS i, right(p_type, -3) AS j, left(p_type, 4) AS k, right(p_type, 4) AS l, substring(p_type, 1, 2) AS m, position('A' IN p_type) AS n,
  replace(p_type, 'S', 'ss') AS o, split_part(p_type, ' ', 2) AS p, concat(p_name, NULL, p_size) AS q, concat_ws('-', p_name, NULL, p_brand) AS r, repeat(p_brand, 2) AS s, reverse(p_brand) AS t, md5(p_name) AS u, sha256(p_name) AS v,
  '''' || replace(p_name || '''s', '''', '''''') || '''' AS w, '"' || p_name || '"' AS x, 'n=' || p_name || ' i="' || p_brand || '" 100%' AS y, regexp_replace(p_type, '[AEIOU]', '_') AS z, regexp_replace(p_type, '([aeiou])', '<\1>', 'gi') AS z2
FROM part""")  # fmt: skip
def string(spark, sf_dir):
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.length(n).cast("long").alias("a"),
        F.bit_length(n).cast("long").alias("b"),
        F.octet_length(n).cast("long").alias("c"),
        F.lower(t).alias("d"),
        F.upper(n).alias("e"),
        scalar.trim(F.concat(F.lit("\t  "), n, F.lit(" \n"))).alias("f"),
        F.lpad(n, 12, "*").alias("g"),
        F.rpad(n, 12, "xy").alias("h"),
        scalar.left(t, -3).alias("i"),
        scalar.right(t, -3).alias("j"),
        scalar.left(t, 4).alias("k"),
        scalar.right(t, 4).alias("l"),
        scalar.substring(t, 0, 3).alias("m"),
        F.locate("A", t).cast("long").alias("n"),
        F.replace(t, F.lit("S"), F.lit("ss")).alias("o"),
        scalar.split_part(t, " ", 2).alias("p"),
        scalar.concat(n, F.lit(None).cast("string"), F.col("p_size")).alias("q"),
        F.concat_ws("-", n, F.lit(None).cast("string"), b).alias("r"),
        F.repeat(b, 2).alias("s"),
        F.reverse(b).alias("t"),
        scalar.md5(n).alias("u"),
        scalar.sha256(n).alias("v"),
        scalar.quote_literal(F.concat(n, F.lit("'s"))).alias("w"),
        scalar.quote_ident(n).alias("x"),
        scalar.format_text("n=%s i=%I 100%%", n, b).alias("y"),
        scalar.regexp_replace(t, "[AEIOU]", "_").alias("z"),
        scalar.regexp_replace(t, "([aeiou])", r"<\1>", "gi").alias("z2"),
    )


@query("fn_bit_string", """
SELECT p_partkey, bin(64 + p_size % 64) AS bits, bit_count(64 + p_size % 64)::INT AS n, substring(bin(64 + p_size % 64), 3, 1)::INT AS g, '1' || '1' || substring(bin(64 + p_size % 64), 3) AS s, lpad(bin((64 + p_size % 64) & 85), 7, '0') AS a, lpad(bin((64 + p_size % 64) | 85), 7, '0') AS o
FROM part""")  # fmt: skip
def bit_string(spark, sf_dir):
    bits, mask = F.bin(F.col("p_size") % 64 + 64), F.lit("1010101")
    return table(spark, sf_dir, "part").select("p_partkey", bits.alias("bits"), scalar.bit_count(bits).alias("n"), scalar.get_bit(bits, 2).alias("g"), scalar.set_bit(bits, 1, 1).alias("s"), scalar.bit_and(bits, mask).alias("a"), scalar.bit_or(bits, mask).alias("o"))


@query("fn_date_time", """
SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, round(extract('second' FROM ts) + extract('microseconds' FROM ts) % 1000000 / 1e6, 6) AS s, epoch_us(ts) AS us, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS th,
  strftime(date_trunc('month', ts), '%Y-%m-%d') AS tm, strftime(time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '2000-01-01 00:05:00'), '%Y-%m-%d %H:%M:%S') AS b, strftime(make_date(year(ts), month(ts), 1), '%Y-%m-%d') AS md,
  datediff('day', DATE '2020-01-01', ts::DATE) AS dd, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 86400000000 AS days, ts < TIMESTAMP '2024-02-01 00:00:00' AND ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-10 00:00:00' AS o
FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:00:00'""")  # fmt: skip
def date_time(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    text = lambda t, f="yyyy-MM-dd HH:mm:ss": F.date_format(t, f)
    part = lambda f, kind="long": temporal.extract(f, ts).cast(kind)
    return table(spark, sf_dir, "events").where("ts >= DATE '2024-01-01'").select(
        "event_id", part("year").alias("y"), part("quarter").alias("q"), part("month").alias("mo"), part("day").alias("d"), part("hour").alias("h"), part("minute").alias("mi"), part("second", "double").alias("s"),
        temporal.micros(ts).alias("us"), text(F.date_trunc("hour", ts)).alias("th"), text(F.date_trunc("month", ts), "yyyy-MM-dd").alias("tm"), text(temporal.date_bin("15 minutes", ts, at("2000-01-01 00:05:00"))).alias("b"),
        text(F.make_date(F.year(ts), F.month(ts), F.lit(1)), "yyyy-MM-dd").alias("md"), temporal.date_diff_days(ts.cast("date"), F.lit("2020-01-01").cast("date")).cast("long").alias("dd"),
        temporal.subtract(ts, at("2024-01-01 00:00:00"))["days"].cast("long").alias("days"),
        temporal.overlaps(ts, temporal.add_interval(ts, temporal.interval_literal("1 hour")), at("2024-01-10 00:00:00"), at("2024-02-01 00:00:00")).alias("o"),
    )


@query("fn_age", """
SELECT o_orderkey, datepart('year', a) * 12 + datepart('month', a) AS months, datepart('day', a) AS days FROM (SELECT o_orderkey, age(TIMESTAMP '1999-03-31 00:00:00', o_orderdate) AS a FROM orders)""")  # fmt: skip
def age(spark, sf_dir):
    a = temporal.age(F.lit("1999-03-31").cast("timestamp"), F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", a["months"].cast("long").alias("months"), a["days"].cast("long").alias("days"))


@query("fn_time_zone", "SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d %H:%M:%S') AS tokyo FROM events")
def time_zone(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format(temporal.at_time_zone(F.col("ts"), "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss").alias("tokyo"))


@query("fn_interval_text", "SELECT * FROM (VALUES ('1 year 2 mons 3 days 04:05:06', 14, 3), ('-1 days', 0, -1), ('00:00:01.5', 0, 0), ('2 mons', 2, 0), ('00:00:00', 0, 0)) t(txt, months, days)")
def interval_text(spark, sf_dir):
    texts = ["1 year 2 months 3 days 04:05:06", "1 day ago", "1500 milliseconds", "2 mons", "0 seconds"]
    rows = spark.createDataFrame([(*temporal.parse_interval(t),) for t in texts], "months int, days int, us bigint")
    return rows.select(temporal.interval_text(temporal.interval(F.col("months"), F.col("days"), F.col("us"))).alias("txt"), "months", "days")


@query("fn_array", """
SELECT vec_id, len(e) AS n, CAST(1 AS INT) AS lo, len(e) AS up, '[1:' || len(e) || ']' AS dims, nullif(list_position(w, label), 0) AS p, array_to_string(w, ',') AS s, list_concat(w, [7])::INT[] AS cat, list_prepend(0, w) AS pre, list_filter(w, lambda x: x IS DISTINCT FROM 3) AS rem,
  list_transform(w, lambda x: CASE WHEN x = 3 THEN 33 ELSE x END) AS rep, w[1:2] AS trimmed, w[2] AS sub, w[9] AS beyond, w[2:3] AS sl, list_contains(w, label) AS any_of
FROM (SELECT vec_id, label, embedding AS e, [1, label, 3]::INT[] AS w FROM embeddings) q""")  # fmt: skip
def array(spark, sf_dir):
    e, w = F.col("embedding"), F.array(F.lit(1), F.col("label"), F.lit(3))
    c = collections
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", c.array_length(e).cast("long").alias("n"), c.array_lower(e).alias("lo"), c.array_upper(e).cast("long").alias("up"), c.array_dims(e).alias("dims"), c.array_position(w, F.col("label")).cast("int").alias("p"),
        c.array_to_string(w, ",", "nil").alias("s"), F.array_append(w, 7).alias("cat"), F.array_prepend(w, 0).alias("pre"), c.array_remove(w, 3).alias("rem"), c.array_replace(w, 3, 33).alias("rep"), c.trim_array(w, 1).alias("trimmed"),
        c.subscript(w, 2).alias("sub"), c.subscript(w, 9).alias("beyond"), c.array_slice(w, 2, 3).alias("sl"), c.eq_any(F.col("label"), w).alias("any_of"),
    )


@query("fn_array_positions", "SELECT n_nationkey, list_filter([1, 2, 3, 4], lambda i: [n_regionkey, 1, n_regionkey, 2][i] = n_regionkey)::INT[] AS p, string_split(n_name, 'A') AS parts FROM nation")
def array_positions(spark, sf_dir):
    r = F.col("n_regionkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", collections.array_positions(F.array(r, F.lit(1), r, F.lit(2)), r).alias("p"), collections.string_to_array(F.col("n_name"), "A").alias("parts"))


@query("fn_json", """
SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has, CAST(NULL AS VARCHAR) AS none, '{"id":' || event_id || ',"t":"' || event_type || '"}' AS built, '{"k":[' || (props->>'$.k') || ',null]}' AS set_k, (props->>'$.k')::INT > 50 AS big FROM events""")  # fmt: skip
def json(spark, sf_dir):
    p = F.col("props")
    k = documents.json_get_text(p, "k")
    return table(spark, sf_dir, "events").select(
        "event_id", k.alias("k"), documents.has_key(p, "k").alias("has"), documents.json_get_text(p, "none").alias("none"), documents.json_build_object(id=F.col("event_id"), t=F.col("event_type")).alias("built"),
        documents.jsonb_set(p, ["k"], F.concat(F.lit("["), k, F.lit(",null]"))).alias("set_k"), documents.jsonb_path_exists(p, "$.k ? (@ > 50)").alias("big"),
    )


@query("fn_json_contains", "SELECT event_id, (props->>'$.k')::INT = 7 AS c FROM events")
def json_contains(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", documents.json_contains(F.col("props"), F.lit('{"k": 7}')).alias("c"))


@query("fn_xml", "SELECT n_nationkey, n_name AS name, n_regionkey::VARCHAR AS region, true AS ok, false AS bad, true AS content, true AS there FROM nation")
def xml(spark, sf_dir):
    x = F.concat(F.lit("<n r='"), F.col("n_regionkey"), F.lit("'><name>"), F.col("n_name"), F.lit("</name></n>"))
    d = documents
    return table(spark, sf_dir, "nation").withColumn("x", d.xmlserialize(x)).select(
        "n_nationkey", F.get(d.xpath(F.col("x"), "/n/name"), F.lit(0)).alias("name"), F.get(d.xpath(F.col("x"), "/n/@r"), F.lit(0)).alias("region"), d.xml_is_well_formed_document(F.col("x")).alias("ok"),
        d.xml_is_well_formed_document(F.concat(F.col("x"), F.lit("<"))).alias("bad"), d.xml_is_well_formed_content(F.concat(F.col("x"), F.lit("text"))).alias("content"), d.xpath_exists(F.col("x"), "/n/name").alias("there"),
    )


@query("fn_network", "SELECT s_suppkey, '10.0.' || (s_suppkey % 256) || '.7' AS host, 4 AS family, 24 AS masklen, '10.0.' || (s_suppkey % 256) || '.0/24' AS net, s_suppkey % 256 < 128 AS inside FROM supplier")
def network(spark, sf_dir):
    a = F.concat(F.lit("10.0."), F.col("s_suppkey") % 256, F.lit(".7/24"))
    d = documents
    return table(spark, sf_dir, "supplier").select("s_suppkey", d.host(a).alias("host"), d.family(a).alias("family"), d.masklen(a).alias("masklen"), d.network(a).alias("net"), d.contained_by_or_equal(a, F.lit("10.0.0.0/17")).alias("inside"))


@query("fn_text_search", """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS v, text FROM documents)
SELECT doc_id, len(v) AS n, list_contains(v, 'the') AND list_contains(v, 'of') AS m, (list_contains(v, 'the')::INT + list_contains(v, 'und')::INT + list_contains(v, 'zzz')::INT) / 3.0::DOUBLE AS r, CAST(3 AS INT) AS nodes, 'the & of' AS tree FROM t""")  # fmt: skip
def text_search(spark, sf_dir):
    s = search
    v = s.to_tsvector(F.col("text"))
    q = s.to_tsquery(F.lit("The of"))
    return table(spark, sf_dir, "documents").withColumn("v", v).select("doc_id", F.size("v").cast("long").alias("n"), s.matches(F.col("v"), q).alias("m"), s.ts_rank(F.col("v"), s.to_tsquery(F.lit("the und zzz"))).alias("r"), s.numnode(q).alias("nodes"), s.querytree(q).alias("tree"))


@query("fn_text_headline", r"SELECT n_nationkey, regexp_replace(n_name || ' of Asia', '(^|[^A-Za-z0-9])(of|asia)', '\1<b>\2</b>', 'gi') AS h FROM nation")
def text_headline(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", search.ts_headline(F.concat(F.col("n_name"), F.lit(" of Asia")), ["OF", "asia"]).alias("h"))


@query("fn_vector", """
SELECT a.vec_id, round(list_distance(a.e, b.e), 6) AS l2, round(1 - list_cosine_similarity(a.e, b.e), 6) AS c, round(list_inner_product(a.e, b.e), 6) AS ip, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))), 6) AS l1, round(sqrt(list_inner_product(a.e, a.e)), 6) AS norm, len(a.e) AS dims
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a, (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 3) b""")  # fmt: skip
def vector(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    one = rows.where("vec_id = 3").select(F.col("embedding").alias("q")).limit(1)
    e, q, s = F.col("embedding"), F.col("q"), search
    return rows.join(F.broadcast(one)).select("vec_id", F.round(s.l2_distance(e, q), 6).alias("l2"), F.round(s.cosine_distance(e, q), 6).alias("c"), F.round(s.inner_product(e, q), 6).alias("ip"), F.round(s.l1_distance(e, q), 6).alias("l1"), F.round(s.vector_norm(e), 6).alias("norm"), s.vector_dims(e).cast("long").alias("dims"))


@query("fn_cast", """
SELECT o_orderkey, CAST(o_orderkey % 100 AS SMALLINT) AS i2, CAST(CAST(o_orderkey AS VARCHAR) AS INTEGER) AS i4, CAST(o_totalprice AS FLOAT)::DOUBLE AS f4, CAST('true' AS BOOLEAN) AS yes, strftime(CAST('2024-02-29' AS DATE), '%Y-%m-%d') AS d, CAST(round(o_totalprice, 2) AS DECIMAL(19, 2)) AS money,
  '12345678-1234-1234-1234-123456789abc' AS u, CAST(o_orderdate AS DATE) = o_orderdate::DATE AS same, 'bigint' AS kind FROM orders""")  # fmt: skip
def cast(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (k % 100).cast("smallint").alias("i2"), k.cast("string").cast("int").alias("i4"), p.cast("float").cast("double").alias("f4"), casts.to_boolean(F.lit(" Ye ")).alias("yes"), F.date_format(F.lit("2024-02-29").cast("date"), "yyyy-MM-dd").alias("d"),
        casts.to_money(F.concat(F.lit("$"), F.format_string("%.2f", p))).alias("money"), casts.to_uuid(F.lit("{12345678123412341234123456789ABC}")).alias("u"), (F.col("o_orderdate").cast("date") == F.to_date("o_orderdate")).alias("same"), scalar.pg_typeof(k).alias("kind"),
    )


@query("fn_range", "SELECT p_partkey, p_size >= 10 AND p_size < 20 AS c, p_size < 20 AND p_size + 5 > 10 AS o, p_size >= 10 AND p_size + 5 <= 20 AS cr, p_size BETWEEN 5 AND 25 AND p_retailprice BETWEEN 900 AND 1200 AS b FROM part")
def ranges(spark, sf_dir):
    c = collections
    size = F.col("p_size")
    fixed = c.make_range(F.lit(10), F.lit(20))
    own = c.make_range(size, size + 5)
    b = c.box(c.point(F.lit(25), F.lit(1200)), c.point(F.lit(5), F.lit(900)))
    return table(spark, sf_dir, "part").select("p_partkey", c.range_contains(fixed, size).alias("c"), c.range_overlaps(fixed, own).alias("o"), c.range_contains_range(fixed, own).alias("cr"), c.box_contains_point(b, c.point(size, F.col("p_retailprice"))).alias("b"))


@query("fn_misc", "SELECT s_suppkey, CASE WHEN n >= 10 * 1024.0 ** 3 THEN round(n / 1024.0 ** 3)::BIGINT || ' GB' WHEN n >= 10 * 1024.0 ** 2 THEN round(n / 1024.0 ** 2)::BIGINT || ' MB' WHEN n >= 10240 THEN round(n / 1024.0)::BIGINT || ' kB' ELSE n || ' bytes' END AS z, 36 AS u FROM (SELECT s_suppkey, s_suppkey * 1000 AS n FROM supplier) q")
def misc(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalar.size_pretty(F.col("s_suppkey") * 1000).alias("z"), F.length(F.expr("uuid()")).alias("u"))
