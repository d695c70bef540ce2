"""Operator 8: a quality classifier on random-indexing word vectors.

Every word has a sparse ternary index vector, made from its hash. A pass over the whole corpus adds up, for each bucket of
words, the index vectors of the words' neighbours; the rows of that table, damped and scaled, are the word vectors. Words
of lower-case letters have buckets by hash, others by their shape (the sequence of their character classes), so the table
has VOCABULARY rows whatever the corpus. A document is pooled into the mean and the spread of its words' vectors, the
roughness (how much neighbours differ) and its length; a two-layer network in numpy, fitted on at most SAMPLE labelled
documents of each class, gives a logit, and a temperature fitted on documents kept apart from its training calibrates the
probability.

Null and empty texts are pooled into zeros and scored like any other; without labels of both classes every score is 0.5.
Rows may repeat; only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import CACHED_BYTES, crc_mod, ship
from tarn.llm.labelled import sample_ids, with_sample

VOCABULARY, SHAPES, DIM, NONZERO = 1 << 14, 1 << 11, 32, 2
SAMPLE = 4_000
HIDDEN, EPOCHS = 24, 60
THRESHOLD = 0.3
CACHE = 600_000
_PLAIN = re.compile(rb"[a-z\x80-\xff]+")
_CLASSES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^Aa0])\1+"), rb"\1"))


def bucket(word: bytes) -> int:
    if _PLAIN.fullmatch(word):
        return zlib.crc32(word) % (VOCABULARY - SHAPES)
    for pattern, to in _CLASSES:
        word = pattern.sub(to, word)
    return VOCABULARY - SHAPES + zlib.crc32(word) % SHAPES


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each bucket's index vector; the same everywhere."""
    rng = np.random.default_rng(8)
    return rng.integers(0, DIM, (VOCABULARY, NONZERO)), rng.choice([-1.0, 1.0], (VOCABULARY, NONZERO))


class Buckets(dict):
    """Buckets of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        b = bucket(word)
        if len(word) <= CACHED_BYTES:
            self[word] = b
        return b

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_KNOWN = Buckets()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total = np.zeros(VOCABULARY * DIM)
    for b in batches:
        rows, n = [], 0
        for t in [*b.column(0), None]:
            if t is not None:
                rows.append(_KNOWN.of(t.as_py()))
                n += len(rows[-1])
            if rows and (t is None or n > 200_000):
                ids = np.concatenate(rows)
                joined = np.ones(len(ids), bool)  # False at a document's end
                joined[np.cumsum([len(r) for r in rows if len(r)], dtype=np.int64) - 1] = False
                left = np.flatnonzero(joined[:-1])
                for i, j in ((ids[left], ids[left + 1]), (ids[left + 1], ids[left])):
                    for k in range(NONZERO):
                        total += np.bincount(i * DIM + places[j, k], signs[j, k], VOCABULARY * DIM)
                rows, n = [], 0
    table = total.reshape(VOCABULARY, DIM).astype(np.int64)
    used = np.flatnonzero(table.any(1))
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(table[used, d]) for d in range(DIM))], names=["bucket", *(f"c{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(VOCABULARY, DIM) from the neighbours of all words of docs. Tasks send sums for each bucket; the table on the driver has a fixed size."""
    ship(docs.sparkSession)
    cols = [f"c{d}" for d in range(DIM)]
    sums = docs.select("text").mapInArrow(_contexts, "bucket bigint, " + ", ".join(f"{c} bigint" for c in cols))
    found = sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in cols)).toArrow()
    table = np.zeros((VOCABULARY, DIM))
    if found.num_rows:
        table[found.column("bucket").to_numpy()] = np.stack([found.column(c).to_numpy() for c in cols], 1)
    table = np.sign(table) * np.sqrt(np.abs(table))  # frequent neighbours count less
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, roughness, share of shaped words and length."""
    out = np.zeros(2 * DIM + 3)
    n = len(ids)
    if n:
        mean, square, rough, cells = np.zeros(DIM), np.zeros(DIM), 0.0, 50_000
        for at in range(0, n, cells):
            v = vectors[ids[at : at + cells + 1]]
            own = v[:cells]
            mean += own.sum(0)
            square += (own * own).sum(0)
            rough += float((np.diff(v, axis=0) ** 2).sum())
        mean /= n
        out[:DIM], out[DIM : 2 * DIM] = mean, np.sqrt(np.maximum(square / n - mean * mean, 0))
        out[2 * DIM :] = rough / max(1, n - 1), np.mean(ids >= VOCABULARY - SHAPES), np.log1p(n) / 10
    return out


@dataclass
class Network:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) * self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray) -> Network:
    """Two layers by Adam on four fifths of the rows, then the temperature with the least log loss on the others."""
    rng = np.random.default_rng(8)
    net = Network(vectors, np.zeros(2 * DIM + 3), np.ones(2 * DIM + 3), np.zeros((2 * DIM + 3, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(set(y.tolist())) < 2:
        return net
    net.shift, net.scale = x.mean(0), 1 / (x.std(0) + 1e-3)
    apart = np.arange(len(y)) % 5 == 0
    z, t = (x[~apart] - net.shift) * net.scale, y[~apart]
    weight = np.where(t > 0, 0.5 / max(1e-9, t.mean()), 0.5 / max(1e-9, 1 - t.mean()))
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v, step = [0 * a for a in p], [0 * a for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 128):
            i = order[at : at + 128]
            h = np.tanh(z[i] @ p[0] + p[1])
            d = weight[i] * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t[i]) / len(i)
            dh = np.outer(d, p[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((z[i].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    logits = net.logits(x[apart])
    loss = lambda s: np.logaddexp(0, np.where(y[apart] > 0, -logits, logits) / s).mean() if apart.any() else 0
    net.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return net


def _pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pool(_KNOWN.of(t), sent.value).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    return docs.select("doc_id", "text", "y").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """labels: doc_id and quality; only rows whose crc32(doc_id as text) mod 5 isn't 0 are learned from."""
    vectors = word_vectors(docs)
    rows = with_sample(docs, sample_ids(labels, "quality", crc_mod(F.col("doc_id"), 5) != 0, sample))
    rows = _pooled(rows, vectors).toArrow().sort_by([("doc_id", "ascending")])
    x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, 2 * DIM + 3)
    return fit(x, rows.column("y").to_numpy().astype(float), vectors)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            x = np.array([pool(_KNOWN.of(t.as_py()), net.vectors) for t in b.column(1)]).reshape(b.num_rows, 2 * DIM + 3)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.score(x), pa.float64())], names=["doc_id", "score"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, train(docs, labels))
    return s.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
