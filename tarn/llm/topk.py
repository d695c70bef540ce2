"""Operator 5: exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows (term, weight). Each block of candidates is turned into posting lists, one for each term; a query
walks its terms one at a time and scatters weight times posting into a dense array of scores, one place for each
candidate of the block. Partition selection keeps the k best of the block with ties to the smaller id, a running merge
keeps the k best of the task, and a ranked merge in Spark joins the tasks.

Queries are handled in blocks of bounded size: each is collected, broadcast and run against all candidates, so that no
candidate is shuffled. Vectors that are null, or hold null or non-finite components, take no part, nor do rows without
an id. Repeated candidate ids are candidates each; a query id that repeats is answered once for each of its rows' vectors,
merged. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import Workspace, ship

#: Queries of one broadcast block; of 64 components they take 8 MB.
QUERY_BLOCK = 16_384
#: Query blocks that are planned as one job.
PLANNED = 8
#: Candidates whose scores are held at once.
CANDIDATES = 16_384
RESULT = "query_id bigint, vec_id bigint, score bigint"


def usable(v: Column) -> Column:
    """A vector without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return v.isNotNull() & ~bad


def quantized(v: Column, scale: int = 256) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _ragged(ids: pa.Array, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, and the nonzero components as (row, term, weight)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    keep = flat != 0
    return ids.to_numpy(zero_copy_only=False).astype(np.int64), row[keep], term[keep], flat[keep]


def postings(row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """Of each term, candidates and weights; candidates are None where the list holds every candidate."""
    order = np.lexsort((row, term))
    terms, starts = np.unique(term[order], return_index=True)
    parts = zip(terms.tolist(), np.split(row[order], starts[1:]), np.split(weight[order], starts[1:]), strict=True) if len(terms) else ()
    return {t: (None if len(r) == rows else r, w) for t, r, w in parts}


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores > cut)
        level = np.flatnonzero(scores == cut)
        more = k - len(places)
        if len(level) > more:
            level = level[np.argpartition(ids[level], more - 1)[:more]] if more else level[:0]
        places = np.concatenate([places, level])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))]


def _search(block, k: int):
    """A map over candidate batches for one broadcast block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, starts, terms, weights = block.value
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q_ids)
        for b in batches:
            for at in range(0, b.num_rows, CANDIDATES):
                part = b.slice(at, CANDIDATES)
                ids, row, term, weight = _ragged(part.column(0), part.column(1))
                lists = postings(row, term, weight, len(ids))
                for i, q in enumerate(q_ids.tolist()):
                    scores = np.zeros(len(ids), np.int64)
                    for j in range(starts[i], starts[i + 1]):
                        if (found := lists.get(int(terms[j]))) is None:
                            continue
                        if found[0] is None:
                            scores += weights[j] * found[1]
                        else:
                            scores[found[0]] += weights[j] * found[1]
                    others = np.flatnonzero(ids != q)
                    own = best(ids[others], scores[others], k)
                    all_ids = np.concatenate([top[i][0], ids[others][own]])
                    all_scores = np.concatenate([top[i][1], scores[others][own]])
                    keep = best(all_ids, all_scores, k)
                    top[i] = all_ids[keep], all_scores[keep]
        n = [len(x[0]) for x in top]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([x[0] for x in top])), pa.array(np.concatenate([x[1] for x in top]))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k highest inner products of each query among all rows but its own id.

    vector: an array of integers (see quantized()). The queries are split by hash into blocks of about QUERY_BLOCK rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    ws = Workspace(spark, "topk")
    queries = ws.table(vectors.where(is_query).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()), "queries")
    count = queries.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    parts = []
    for i in range(blocks if count else 0):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        column = part.column("v").combine_chunks()
        ids, row, term, weight = _ragged(part.column("vec_id").combine_chunks(), column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        starts = np.searchsorted(row, np.arange(len(ids) + 1))
        sent = spark.sparkContext.broadcast((ids, starts, term, weight))
        parts.append(rows.mapInArrow(_search(sent, k), RESULT))
        if blocks > PLANNED:  # many blocks run one after the other, and leave the driver again
            parts[-1] = ws.table(parts[-1], "block")
            sent.destroy()
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
