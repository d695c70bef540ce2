"""Operator 10: toxic spans and document scores from a linear-chain conditional random field.

Tokens are words at ASCII white space. Labels are known for documents only, so tokens are labelled first: in a document
marked toxic, a token is toxic if one of its features (the folded word, its first four and five letters) is far more
frequent in toxic than in clean training documents. A two-state chain with a weight for each hashed feature and
transitions between neighbours is then trained on these tokens by gradient ascent of the conditional likelihood. In
scoring, forward and backward recursions give each token's marginal; the marginals' sum, maximum and density go through a
logistic layer, fitted on the documents' labels, to the document's score, and runs of tokens above one half are its spans.

The fit uses whole texts of at most SAMPLE labelled documents of each class and of at most SAMPLE_TOKENS tokens of each
class; a document that would exceed the latter is passed over. Executors cut texts into features and count them; the driver
gets a count for each of BUCKETS features, and numbers of the features of the sample's tokens, cut into chains of CHAIN
tokens for the gradient. In scoring, chains are whole documents. Null and empty texts have no tokens and get the
score of a document without toxic tokens; without labels of both classes every score is 0. Null ids and repeated rows are scored like
any other; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import CACHED_BYTES, Workspace, crc_mod, ship, words_count
from tarn.llm.labelled import sample_ids, with_sample

SAMPLE = 2_000
SAMPLE_TOKENS = 1_500_000
CHAIN = 256
BUCKETS = 1 << 18
STEPS = 40
THRESHOLD = 0.7
#: Chains whose recursions run side by side, and how many places they may take together (one chain alone may take more).
SIDE, PLACES = 1_024, 1 << 18
#: Words of at most CACHED_BYTES whose emissions a task remembers.
CACHE = 400_000
_LETTERS = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCORED = "doc_id bigint, score double, n_toxic bigint, spans array<struct<start:int,stop:int>>"


def features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a token: its letters in lower case, and their first five and four."""
    s = "".join(_LETTERS.findall(word.decode("utf-8", "replace").lower()))
    found = [f"w:{s}"] + [f"{n}:{s[:n]}" for n in (5, 4) if len(s) > n]
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in found) if s else ()


def marginals(e: np.ndarray, mask: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token of chains laid side by side, and the ratios of the recursions.

    e: (steps, chains), the factor of state 1 against state 0; mask: where there are tokens; a: factors of the transitions.
    Only ratios of the two states are carried, so nothing under- or overflows.
    """
    steps, chains = e.shape
    r, s = np.empty_like(e), np.empty_like(e)
    before = np.zeros(chains)  # chains start in state 0
    for t in range(steps):
        before = r[t] = np.where(mask[t], e[t] * (a[0, 1] + before * a[1, 1]) / (a[0, 0] + before * a[1, 0]), 0.0)
    after = np.ones(chains)
    for t in range(steps - 1, -1, -1):
        s[t] = after
        x = e[t] * after
        after = np.where(mask[t], (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x), 1.0)
    odds = r * s
    return odds / (1 + odds), r, s


def laid_out(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of chains of like length, whose layout is bounded."""
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        group = order[at : at + SIDE]
        fits = np.searchsorted(lengths[group] * np.arange(1, len(group) + 1), PLACES, side="right")
        yield group[: max(1, fits)]
        at += max(1, fits)


def side_by_side(values: list[np.ndarray], dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(v) for v in values])
    mask = np.arange(n.max(initial=0))[:, None] < n[None, :]
    out = np.zeros(mask.shape, dtype)
    for i, v in enumerate(values):
        out[: len(v), i] = v
    return out, mask


class Model:
    def __init__(self):
        self.w = np.zeros(BUCKETS, np.float32)
        self.bias, self.trans = -6.0, np.zeros((2, 2))
        self.layer = None  # of the document score: offset, then a weight for each of doc_features()

    def emission(self, word: bytes) -> float:
        return float(np.exp(np.clip(self.bias + sum(float(self.w[f]) for f in features(word)), -30, 30)))

    def marginals(self, docs: list[list[bytes]], cache: dict) -> list[np.ndarray]:
        """Of each token of each document."""
        rows, long = [], {}
        if len(cache) > CACHE:
            cache.clear()
        for words in docs:
            for w in words:
                if w not in cache:
                    if len(w) > CACHED_BYTES or len(cache) > CACHE:
                        long[w] = self.emission(w)
                    else:
                        cache[w] = self.emission(w)
            rows.append(np.fromiter((cache[w] if w in cache else long[w] for w in words) if long else map(cache.__getitem__, words), np.float64, len(words)))
            long.clear()
        out: list[np.ndarray] = [np.empty(0)] * len(rows)
        a = np.exp(self.trans)
        for group in laid_out(np.array([len(r) for r in rows], np.int64)):
            e, mask = side_by_side([rows[i] for i in group])
            p, _, _ = marginals(e, mask, a)
            for j, i in enumerate(group):
                out[i] = p[: len(rows[i]), j]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.layer is None else 1 / (1 + np.exp(-np.clip(self.layer[0] + x @ self.layer[1:], -40, 40)))


def doc_features(p: np.ndarray) -> list[float]:
    total, top = float(p.sum()), float(p.max(initial=0.0))
    second = float(np.partition(p, len(p) - 2)[-2]) if len(p) > 1 else 0.0
    return [np.log1p(total), top, second, min(1.0, 20 * total / max(1, len(p)))]


def feature_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many documents of each class have each feature, as an array (2, BUCKETS), and the numbers of documents. sample: doc_id, text, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = {f for w in set((text.as_py() or "").encode("utf-8", "replace").split()) for f in features(w)}
                seen[y, list(found)] += 1
                n[y] += 1
        at = np.flatnonzero(seen)
        cells, counts = np.append(at, [2 * BUCKETS, 2 * BUCKETS + 1]), np.append(seen.reshape(-1)[at], n)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts, pa.int64())], names=["cell", "n"])

    rows = sample.select("text", "y").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * BUCKETS + 2, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out[:-2].reshape(2, BUCKETS), out[-2:]


def marks(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which features mark toxic documents: in at least 4 of them and 12 times as often as in clean ones."""
    return (seen[1] >= 4) & (seen[1] / max(1, n[1]) >= 12 * (seen[0] + 0.5) / max(1, n[0]))


def companions(sample: DataFrame, marked: np.ndarray) -> np.ndarray:
    """All features of words that have a marked one. Words without any of these share one weight, the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for b in batches:
            for text in b.column(0):
                for w in set((text.as_py() or "").encode("utf-8", "replace").split()):
                    fs = features(w)
                    if any(marked[f] for f in fs):
                        found.update(fs)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["f"])

    return np.sort(sample.select("text").mapInArrow(run, "f bigint").distinct().toArrow().column("f").to_numpy())


HITS = "y int, tokens int, at binary, f binary, truth binary"


def hits(sample: DataFrame, used: np.ndarray, marked: np.ndarray):
    """Of each document: its class, tokens, the places and numbers (in used) of its tokens' features, and the places of its toxic tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words, known = (text.as_py() or "").encode("utf-8", "replace").split(), {}
                at, which, truth = [], [], []
                for t, w in enumerate(words):
                    if w not in known:
                        fs = np.array(features(w), np.int64)
                        i = np.searchsorted(used, fs)
                        i = i[(i < len(used)) & (used[np.minimum(i, max(0, len(used) - 1))] == fs)] if len(used) and len(fs) else fs[:0]
                        known[w] = i.tolist(), bool(y) and bool(marked[fs].any())
                    own, hot = known[w]
                    at += [t] * len(own)
                    which += own
                    truth += [t] * hot
                rows.append((y, len(words), *(np.array(x, "<i4").tobytes() for x in (at, which, truth))))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["y", "tokens", "at", "f", "truth"])

    return sample.select("text", "y").mapInArrow(run, HITS).toArrow()


def chain_groups(rows) -> list[tuple]:
    """The sample's tokens as chains of at most CHAIN tokens, side by side: mask, truth, and places (step, chain) and numbers of features."""
    lengths, steps, chains, numbers, true_steps, true_chains, n = [], [], [], [], [], [], 0
    for tokens, *parts in zip(rows.column("tokens").to_pylist(), *(rows.column(c).to_pylist() for c in ("at", "f", "truth")), strict=True):
        at, f, truth = (np.frombuffer(x, "<i4") for x in parts)
        steps.append((at % CHAIN).astype(np.int16))
        chains.append(at // CHAIN + n)
        numbers.append(f)
        true_steps.append(truth % CHAIN)
        true_chains.append(truth // CHAIN + n)
        lengths += [min(CHAIN, tokens - k) for k in range(0, tokens, CHAIN)]
        n = len(lengths)
    lengths = np.array(lengths, np.int64)
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (steps, chains, numbers, true_steps, true_chains)]
    groups, column, group_of = [], np.empty(n, np.int64), np.empty(n, np.int64)
    laid = list(laid_out(lengths))
    for k, g in enumerate(laid):
        column[g], group_of[g] = np.arange(len(g)), k
    by, true_by = np.argsort(group_of[flat[1]], kind="stable"), np.argsort(group_of[flat[4]], kind="stable")
    ends = np.searchsorted(group_of[flat[1]][by], np.arange(len(laid) + 1))
    true_ends = np.searchsorted(group_of[flat[4]][true_by], np.arange(len(laid) + 1))
    for k, g in enumerate(laid):
        mask = np.arange(lengths[g].max(initial=0))[:, None] < lengths[g][None, :]
        z = np.zeros(mask.shape, bool)
        i, j = by[ends[k] : ends[k + 1]], true_by[true_ends[k] : true_ends[k + 1]]
        z[flat[3][j], column[flat[4][j]]] = True
        groups.append((mask, z, flat[0][i].astype(np.int64), column[flat[1][i]], flat[2][i].astype(np.int64)))
    return groups


def gradient_ascent(groups: list[tuple], k: int) -> np.ndarray:
    """Weights of k features, the bias and the four transitions that make the truth of the chains likely."""
    theta = np.concatenate([np.zeros(k), [-4.0], np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    tokens = sum(int(g[0].sum()) for g in groups)
    for step in range(1, STEPS + 1):
        grad = np.zeros_like(theta)
        a = np.exp(theta[k + 1 :].reshape(2, 2))
        for mask, z, t, d, f in groups:
            x = np.full(mask.shape, theta[k])
            np.add.at(x, (t, d), theta[f])
            e = np.exp(np.clip(x, -30, 30))
            p, r, s = marginals(e, mask, a)
            gap = np.where(mask, z - p, 0.0)
            grad[k] += gap.sum()
            grad[:k] += np.bincount(f, gap[t, d], k)[:k]
            # expected transitions: of each pair of neighbours, in proportion to r(t-1), a, e(t) and s(t)
            r0 = np.vstack([np.zeros((1, mask.shape[1])), r[:-1]])
            q1 = e * s
            parts = np.stack([a[0, 0] + 0 * r0, a[0, 1] * q1, r0 * a[1, 0], r0 * a[1, 1] * q1])
            parts /= parts.sum(0)
            z0 = np.vstack([np.zeros((1, mask.shape[1]), bool), z[:-1]])
            real = np.stack([~z0 & ~z, ~z0 & z, z0 & ~z, z0 & z])
            grad[k + 1 :] += np.where(mask, real - parts, 0.0).sum((1, 2))
        grad = grad / max(1, tokens) * 200 - 1e-3 * np.concatenate([theta[:k], np.zeros(5)])
        m, v = 0.8 * m + 0.2 * grad, 0.95 * v + 0.05 * grad**2
        theta = theta + 0.5 * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-6)
    return theta


def fit(sample: DataFrame) -> Model:
    """From whole texts of a bounded sample: doc_id, text and y, as a written table."""
    model = Model()
    seen, n = feature_counts(sample)
    if not n.all():
        return model
    marked = marks(seen, n)
    used = companions(sample, marked)
    theta = gradient_ascent(chain_groups(hits(sample, used, marked)), k := len(used))
    model.w[used] = theta[:k]
    model.bias, model.trans = float(theta[k]), theta[k + 1 :].reshape(2, 2) - theta[k + 1]
    model.layer = fit_layer(sample, model)
    return model


def fit_layer(sample: DataFrame, model: Model) -> np.ndarray:
    """The logistic layer, from the features that the chain gives the sample's documents."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = sent.value, {}
        for b in batches:
            for part in parts_of(b):
                ps = model.marginals([(t or "").encode("utf-8", "replace").split() for t in part.column(0).to_pylist()], cache)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([doc_features(p) for p in ps], pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.select("text", "y").mapInArrow(run, "y int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float)
    order = np.lexsort((*x.T, rows.column("y").to_numpy()))  # sums then don't depend on the order of rows
    return logistic(x[order], rows.column("y").to_numpy()[order].astype(float))


def parts_of(batch: pa.RecordBatch, rows: int = 2_000, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of so many rows and about so many bytes; a longer row is alone."""
    if not batch.num_rows:
        return
    step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By Newton's method with a small ridge; both classes weigh the same."""
    x = np.hstack([np.ones((len(x), 1)), x])
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        ridge = 0.02 * np.eye(len(b))
        ridge[0, 0] = 1e-6
        h = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + ridge * len(y) * 0.01
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - (ridge * len(y) * 0.01) @ b)
        b = b + np.clip(step, -5, 5)
    return b


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Offsets in code points of runs of tokens above one half."""
    out: list[dict] = []
    hot, last = set(np.flatnonzero(p > 0.5).tolist()), -2
    if hot:
        for i, m in enumerate(_WORD.finditer(text)):
            if i in hot:
                if out and last == i - 1:
                    out[-1]["stop"] = m.end()
                else:
                    out.append({"start": m.start(), "stop": m.end()})
                last = i
    return out


def bounded(sizes: DataFrame, most: int) -> list:
    """The ids to learn from, by the hashes of their ids, of each class as many as have at most so many tokens together."""
    kept, total = [], [0, 0]
    for doc_id, y, n in map(tuple, sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect()):  # at most 2 * SAMPLE rows
        if total[y] + n <= most:
            total[y] += n
            kept.append(doc_id)
    return kept


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, tokens: int = SAMPLE_TOKENS) -> Model:
    """labels: doc_id and toxic; only rows whose crc32(doc_id as text) mod 3 isn't 1 are learned from."""
    spark = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "toxicity")
    rows = ws.table(with_sample(docs, sample_ids(labels, "toxic", crc_mod(F.col("doc_id"), 3) != 1, sample)), "sample")
    kept = bounded(rows.groupBy("doc_id", "y").agg(F.sum(words_count(F.col("text"))).alias("n")), tokens)
    ids = spark.createDataFrame([(i,) for i in kept], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}")
    model = fit(rows.join(F.broadcast(ids), "doc_id", "left_semi"))
    ws.drop(rows)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_toxic tokens and spans of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = sent.value, {}
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for b in batches:
            for part in parts_of(b):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ps = model.marginals([t.encode("utf-8", "replace").split() for t in texts], cache)
                x = np.array([doc_features(p) for p in ps]).reshape(len(ps), -1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(model.score(x), pa.float64()), pa.array([int((p > 0.5).sum()) for p in ps], pa.int64()), pa.array([spans(t, p) for t, p in zip(texts, ps, strict=True)], span)],
                    names=["doc_id", "score", "n_toxic", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold. They are filtered where they are read."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = sent.value, {}
        for b in batches:
            for part in parts_of(b):
                ps = model.marginals([(t or "").encode("utf-8", "replace").split() for t in part.column("text").to_pylist()], cache)
                x = np.array([doc_features(p) for p in ps]).reshape(len(ps), -1)
                yield part.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, train(docs, labels))
    return s.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic", "spans")
