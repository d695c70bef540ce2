"""The corpus operators as queries over the tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import jaccard, lines, media, mixing, packing, quality, secrets, tokens, topk, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.report(secrets.findings_by_path(docs, secrets.scan_new(docs), ["doc_id"]))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("copies")


ORACLES["op4_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
c AS (
  SELECT *, coalesce(sum(cap) OVER b, 0) AS full_caps, coalesce(sum(weight) OVER b, 0) AS used, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT *, total - full_caps AS left_words, all_weight - used AS share FROM c),
level AS (SELECT full_caps AS f, used AS u, left_words AS lw, share AS sh FROM l WHERE left_words * weight <= cap * share ORDER BY 1, 2 LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN f IS NULL OR full_caps < f OR used < u THEN cap::DOUBLE ELSE (lw * weight)::DOUBLE / sh::DOUBLE END AS target
  FROM l LEFT JOIN level ON true
), v AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), r AS (SELECT *, target - whole * source_size AS rest, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS p FROM v),
k AS (
  SELECT d.doc_id, d.size, r.*, CASE WHEN p > 0 AND d.size > 0 THEN (d.u / (1 - d.u)) / (p / (1 - p)) END AS rk FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), a AS (
  SELECT *, rk IS NOT NULL AND sum(CASE WHEN rk IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rk NULLS LAST, size, doc_id ROWS UNBOUNDED PRECEDING) <= rest AS sampled FROM k
), g AS (SELECT *, rest - coalesce(sum(CASE WHEN sampled THEN size END) OVER (PARTITION BY source), 0) AS gap FROM a),
f AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY NOT (rk IS NOT NULL AND NOT sampled AND abs(size - gap) < gap), abs(size - gap), rk, size, doc_id) = 1 AND rk IS NOT NULL AND NOT sampled AND abs(size - gap) < gap AS closes FROM g
)
SELECT doc_id, size, source_size, target, (whole + sampled::INT + closes::INT) * size AS taken FROM f
"""


@query
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    return topk.top_k(rows.withColumn("embedding", topk.quantized(F.col("embedding"))), F.col("vec_id") % 50 == 0)


ORACLES["op5_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_media(media.store_texts(read(spark, sf_dir, "documents")))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return t.withColumn("spans", F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s.start, s.stop))))


@query
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents")).drop("n_links")


ORACLES["op6_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM d
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM g UNION SELECT l.b, reach.c FROM reach JOIN links l ON reach.doc_id = l.a)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, r.component_id FROM g JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) r ON g.doc_id = r.doc_id
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read(spark, sf_dir, "documents"))
