"""Full-text and vector functions, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Text: tokens are runs of ASCII letters and digits, in lower case ------------------------------------------------------------
def to_tsvector(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]+)"), 1)


def to_tsquery(s: Column) -> Column:
    """All query forms mean: each of these terms."""
    return F.array_distinct(to_tsvector(s))


plainto_tsquery = websearch_to_tsquery = phraseto_tsquery = to_tsquery


def matches(document: Column, query: Column) -> Column:
    """document @@ query; an empty query matches nothing."""
    return (F.size(query) > 0) & (F.size(F.array_except(query, document)) == 0)


def ts_rank(document: Column, query: Column) -> Column:
    """The share of the query's terms that the document has."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, document)) / F.size(query))


ts_rank_cd = ts_rank


def ts_headline(s: Column, query: list[str], start: str = "<b>", stop: str = "</b>") -> Column:
    """The text with its matching tokens marked."""
    terms = [t for t in (q.lower() for q in query) if t.isalnum() and t.isascii()]
    if not terms:
        return s
    return F.regexp_replace(s, rf"(?i)(?<![A-Za-z0-9])({'|'.join(terms)})(?![A-Za-z0-9])", f"{start}$1{stop}")


def numnode(query: Column) -> Column:
    """Terms, and the ANDs between them."""
    return F.greatest(F.size(query) * 2 - 1, F.lit(0))


def querytree(query: Column) -> Column:
    return F.array_join(query, " & ")


# Vectors -------------------------------------------------------------------------------------------------------------------
def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def same_dims(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("different vector dimensions")).cast("array<double>"))


def _pair(a: Column, b: Column, f) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return _sum(F.zip_with(same_dims(a, b), b, f))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_pair(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda x, y: F.abs(x - y))


def inner_product(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda x, y: x * y)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def vector_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a.cast("array<double>"), lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    """An error for a vector of zeros."""
    norms = vector_norm(a) * vector_norm(b)
    return F.when(norms == 0, F.raise_error(F.lit("cosine distance of a zero vector")).cast("double")).otherwise(1 - inner_product(a, b) / norms)


def vector_dims(a: Column) -> Column:
    return F.size(a)


DISTANCES = {"l2": l2_distance, "l1": l1_distance, "ip": negative_inner_product, "cosine": cosine_distance}


def hamming_distance(a: Column, b: Column) -> Column:
    """Of bit vectors, as text of 0 and 1."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def sparse_inner_product(a: Column, b: Column) -> Column:
    """Of maps from index to weight."""
    return F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.element_at(b, k))
