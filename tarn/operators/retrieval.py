"""Vector, full-text and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.search import DISTANCES
from tarn.operators.relational import ranked
from tarn.workspace import Workspace

#: Fixed values of the score.
K1, B, RRF = 1.2, 0.75, 60


def vector_top_k(df: DataFrame, vector: str, query: list[float], k: int, metric: str = "l2", where: Column | None = None, ties: str | None = None) -> DataFrame:
    """The k nearest rows, exactly: each task keeps k, and one takes the best of those. where is applied first."""
    rows = df if where is None else df.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    out = rows.withColumn("distance", DISTANCES[metric](F.col(vector), q))
    return out.orderBy("distance", *([ties] if ties else [])).limit(k)


def _is(word: str):
    return lambda t: t == word


def bm25(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key and score of the rows that have a term of the query. Statistics are those of df, so filters belong before.

    A pass over the texts writes a narrow table of lengths and term counts, from which statistics and scores are made.
    """
    import re

    terms = list(dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())))
    if not terms:
        return df.select(key, F.lit(0.0).alias("bm25")).limit(0)
    low = F.lower(text)
    hits = F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9])({'|'.join(terms)})(?![a-z0-9])"), 1)
    docs = df.select(key, F.coalesce(F.regexp_count(low, F.lit("[a-z0-9]+")), F.lit(0)).alias("len"), F.coalesce(hits, F.array().cast("array<string>")).alias("hits"))
    docs = Workspace(df.sparkSession, "bm25").table(docs.select(key, "len", *(F.size(F.filter("hits", _is(w))).alias(f"tf{i}") for i, w in enumerate(terms))), "counts")
    stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))))
    rows = docs.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, n, dfi = F.col(f"tf{i}"), F.col("n"), F.col(f"df{i}")
        idf = F.ln((n - dfi + 0.5) / (dfi + 0.5) + 1)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.select(key, score.alias("bm25")).where("bm25 > 0")


def hybrid_search(df: DataFrame, key: str, text: str, query: str, vector: str, probe: list[float], k: int, fusion: str = "weighted", weights: tuple[float, float] = (1.0, 1.0), metric: str = "l2") -> DataFrame:
    """key, score, bm25 and similarity of the k best rows; ties go to the smaller key.

    weighted: the weighted sum of BM25 and of 1 / (1 + distance). rrf: the sum of weight / (60 + rank); a row that matches no
    term has no text rank. Ranks come from the whole set, in an order by score and key, so rrf sorts it, by ranges.
    """
    q = F.array(*(F.lit(float(x)) for x in probe))
    distance = DISTANCES[metric](F.col(vector), q)
    similarity = -distance if metric == "ip" else 1 / (1 + distance)
    rows = df.select(key, F.when(F.col(vector).isNotNull(), similarity).alias("similarity")).join(bm25(df, key, text, query), key, "left")
    if fusion == "weighted":
        score = weights[0] * F.coalesce("bm25", F.lit(0.0)) + weights[1] * F.coalesce("similarity", F.lit(0.0))
    elif fusion == "rrf":
        for c in ("bm25", "similarity"):
            rows = ranked(rows, f"{c}_rank", [F.col(c).desc_nulls_last(), F.col(key)]).withColumn(f"{c}_rank", F.when(F.col(c).isNotNull(), F.col(f"{c}_rank")))
        part = lambda c, w: F.coalesce(w / (RRF + F.col(f"{c}_rank")), F.lit(0.0))
        score = part("bm25", weights[0]) + part("similarity", weights[1])
    else:
        raise ValueError(f"unknown fusion {fusion!r}")
    return rows.select(key, score.alias("score"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "similarity").orderBy(F.col("score").desc(), key).limit(k)
