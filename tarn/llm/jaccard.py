"""Operator 6: self-join of documents by the Jaccard similarity of their word shingles, with components.

Documents with the same set of shingles are one node. The universe of shingles is cut by hash into segments; two sets whose
symmetric difference is at most H agree in one of H + 1 segments, by the pigeonhole principle. Sizes fall into bands so wide
that similar sets lie in one band or in neighbouring ones, and each band has a table with its own number of segments, which
holds the sets of the band and, of the band below, those that are large enough. For each table an allocation is chosen by
cost: a segment may be indexed by its subset of the set alone, which proves one difference where no other set has it, or by
that subset and all of its one-deletion neighbours, which proves two. Subsets of one shingle, which sets that are far apart
often share, and empty ones are not indexed, unless a set's other segments prove too little; a pair is then found from its
other set, or both index theirs.

Pairs are not formed within a group that shares an index entry; each group has a hub, its member with most entries that others
have as well. First each node is compared with one hub, the heaviest of its groups', and what is verified is joined into
components. Only the groups whose members are then in different components go on: all members of such a group are compared
with its hub, which in groups of more than two also gives what they add to it and lack of it, and components are joined again.
For groups whose members, but for the hub, are still apart, let D be the signed set of a member's additions and lacks. Two members differ in as many elements as their D's do, and
similar members of different components have at least one element of D in common (were there none, both would be similar to
their hub). So members of a hub are joined on the elements of D by the prefix filter with positions, in an order by rarity within the hub if
both are near it, else in the order of hashes, of which fewer elements are needed: at the first element in common, what precedes it on both sides and the difference of what remains are
differences of the two sets. Elements that only one component has lead nowhere, but count as positions; by rarity, they come first of all. What remains is verified. Every comparison is exact, on 64-bit hashes of all shingles.

Null and empty texts have no shingles and are linked with nothing; fewer words than a shingle make one. Null ids are
allowed: they never are a component's smallest id unless it has no other. Repeated rows are one node. Only the id and text
columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import BROADCAST_ROWS, Workspace, held, same_row, ship, small
from tarn.llm.components import components

SHINGLE, PERCENT = 4, 85
#: Index entries are grouped in so many passes, each over a share of the keys, so that a pass's shuffle files can go before the next.
PASSES = 4
#: Keys or pairs of nodes, of which up to so many are broadcast: at most 16 bytes each.
NARROW_ROWS = 4 * BROADCAST_ROWS
#: Members with at most so many times the differences of similar sets are near their hub.
NEAR = 2
#: Of the cost of an allocation: what a segment that two unlike sets share costs, and how likely one more shingle in common is.
SHARED_COST, SHARED = 200.0, 0.35
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; A-Z fold to lower case."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(k, n)
    h = np.full(n - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = h * _M1 + w[i : i + len(h)]
        return np.unique(mixed(h))


class Bands:
    """Tables, their segments and allocations for one threshold."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            low = self.lows[-1]
            self.lows.append(max(low + 1, -(-low * 10_000 // percent**2)))

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def largest(self, n: int) -> int:
        """The size of the largest set that can be similar to one of size n."""
        return 100 * n // self.percent

    def differences(self, n: int, m: int) -> int:
        """Most differences of similar sets of sizes n and m."""
        return (100 - self.percent) * (n + m) // (100 + self.percent)

    @lru_cache(maxsize=None)
    def plan(self, band: int) -> tuple[int, int]:
        """Segments of a band's table, and how many of them are indexed with their deletions."""
        low, high = self.lows[band], self.lows[band + 1] - 1
        need = self.differences(high, high) + 1
        best = None
        for d in range(0, min(need // 2, 8) + 1):
            m = need - d
            s = max(low, high * 0.85) / m
            cost = (m - d) + d * (1 + s) + SHARED_COST * m * SHARED**s
            if best is None or cost < best[0]:
                best = cost, m, d
        m, d = best[1], best[2]
        m += int(np.ceil(2 * m * np.exp(-low / m))) * (m > 2)
        # more segments, until those of two or more shingles prove enough for most sets; a few large sets may still need others
        for more in range(m, m + m // 4 + 1):
            few = more * np.exp(-high / more) * (1 + high / more)
            if more + d - few - 2 * np.sqrt(few) >= need:
                return more, d
        return m, d

    def tables(self, n: int) -> list[int]:
        band = self.of(n)
        return [band, band + 1] if self.largest(n) >= self.lows[band + 1] else [band]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Index entries of a set in all of its tables."""
        n, out = len(s), []
        content = mixed(s + _M1)
        for band in self.tables(n):
            high = self.lows[band + 1] - 1
            need = self.differences(n, min(high, self.largest(n))) + 1
            if need <= 1:
                continue  # only equal sets are similar
            m, d = self.plan(band)
            segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            starts = np.flatnonzero(np.diff(segment, prepend=np.uint64(m)))
            sums, ids = np.add.reduceat(content, starts), segment[starts]
            sizes = np.diff(np.append(starts, n))
            deleting = ids < d
            seed = np.uint64((band * 1_000_003) & 0xFFFFFFFF) << np.uint64(32)
            # single shingles, which unlike sets often share, are indexed only where larger subsets prove too little, and empty ones where all others do
            least = 2 if np.where(deleting & (sizes > 2), 2, sizes > 1).sum() >= need else 1
            proven = np.where(deleting & (sizes > 1), 2, 1).sum()
            whole = sizes >= least
            out.append(mixed(mixed(ids[whole] + seed) + sums[whole]))
            for j in np.flatnonzero(deleting):
                if sizes[j] > least or proven < need:
                    part = content[starts[j] : starts[j] + sizes[j]]
                    out.append(mixed(mixed(ids[j] + seed) + (sums[j] - part)))
            if proven < need:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), ids, assume_unique=True)
                out.append(mixed(mixed(empty + seed)))
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _node(s: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit name, as two numbers."""
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _index(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                n, names, keys = [], [], []
                for t in b.column(2):
                    s = shingle_set(t.as_py(), shingle)
                    n.append(len(s))
                    names.append(_node(s))
                    keys.append(s[:0] if names[-1] in seen or not len(s) else bands.keys(s))  # a task indexes a set once
                    seen.add(names[-1])
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["doc_id", "text_key", "n", "node", "node2", "keys"],
                )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                sets = [shingle_set(t.as_py(), shingle) for t in b.column(0).slice(at, 1_000)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return run


def _compare(percent: int, differences: bool):
    """(a, b, sets of both) to whether they are similar and, if asked for, b's size and what it adds to a and lacks of it.

    Of members that are not near their hub, adds and lacks have only what the prefix filter needs in the order of hashes.
    """
    bands = Bands(percent)

    def difference(s: np.ndarray, t: np.ndarray, in_s: np.ndarray) -> tuple:
        adds, lacks, most = t[~in_s], s[~_within(s, t)], bands.differences(len(t), bands.largest(len(t)))
        counts, near = (len(t), len(adds), len(lacks)), len(adds) + len(lacks) <= NEAR * most
        if not near:
            adds, lacks = adds[: most + 1], lacks[: max(0, most + 1 - len(adds))]
        return *counts, near, adds.view(np.int64), lacks.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                in_s = _within(t, s)
                common = int(in_s.sum())
                similar = 100 * common >= percent * (len(s) + len(t) - common)
                rows.append((similar, *difference(s, t, in_s)) if differences else (similar,))
            kinds = [pa.bool_(), *[pa.int64()] * 3, pa.bool_(), *[pa.list_(pa.int64())] * 2][: 7 if differences else 1]
            found = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["a", "b", "similar", "n", "added", "lacking", "near", "adds", "lacks"][: 2 + len(kinds)])

    return run


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of x are in y; both are sorted."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def compared(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """The pairs (a, b) of nodes, a written table, compared. b's sets meet the pairs first, then travel to a's.

    Pairs are two numbers: where they are counted to be few enough, they are sent to the sets, and sets move once.
    """
    few = pairs.limit(NARROW_ROWS + 1).count() <= NARROW_ROWS
    sent = F.broadcast if few else lambda df: df
    a_only = sets.join(sent(pairs.select(F.col("a").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    one = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).join(sent(pairs), "b")
    out = "a bigint, b bigint, similar boolean" + (", n bigint, added bigint, lacking bigint, near boolean, adds array<bigint>, lacks array<bigint>" if differences else "")
    return one.join(a_only, "a").select("a", "b", "sa", "sb").mapInArrow(_compare(percent, differences), out)


def shared_entries(ws: Workspace, indexed: DataFrame) -> list[DataFrame]:
    """key and node of the index entries that more than one node has, as written tables."""
    entries = indexed.select("node", F.explode("keys").alias("key"))
    parts = []
    for i in range(PASSES):
        some = entries.where(F.pmod("key", F.lit(PASSES)) == i)
        groups = ws.table(some.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key"), "groups")
        parts.append(ws.table(some.join(small(groups, NARROW_ROWS), "key").distinct(), "entries"))
        ws.drop(groups)
    return parts


def with_hubs(shared: DataFrame) -> DataFrame:
    """key, node, hub and the hub's weight; a group's hub is the member with most entries that others have as well."""
    weighted = shared.join(shared.groupBy("node").agg(F.count("*").alias("weight")), "node")
    hub = weighted.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("m"))
    return shared.join(hub.select("key", F.col("m.node").alias("hub"), F.col("m.weight").alias("weight")), "key")


def node_sets(ws: Workspace, keyed: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and shingles of the nodes, each from one row of the documents."""
    places = rows.join(nodes, "node", "left_semi").groupBy("node", "doc_id", "text_key").agg(F.count("*").alias("times"))
    first = ws.table(places.groupBy("node").agg(F.min(F.struct("times", "doc_id", "text_key")).alias("r")).select(F.col("r.doc_id").alias("id"), F.col("r.text_key").alias("tk"), "r.times"), "first")
    texts = keyed.join(small(first), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("tk")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(shingle), "node bigint, shingles binary")
    # only a node all of whose rows are repeated has more than one row here
    return ws.table(sets if first.where("times > 1").isEmpty() else sets.dropDuplicates(["node"]), "sets")


def still_mixed(stars: DataFrame, labels: DataFrame, hubs_too: bool) -> DataFrame:
    """The rows of the groups whose members are in more than one component, with their labels; of the members but the hub unless hubs_too."""
    known = stars if hubs_too else stars.where("node <> hub")
    known = known.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_keys = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    return known.join(mixed_keys.select("key", "members"), "key")


def rest_pairs(ws: Workspace, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one hub and of different components that can be similar; see the module's account.

    tried: a (the hub), b, n, added, lacking, near, adds, lacks and label. Two near members are joined in the order of rarity,
    others in that of hashes, additions first.
    """
    signed = F.concat(F.transform("adds", lambda x: F.struct(F.lit(True).alias("plus"), x.alias("el"))), F.transform("lacks", lambda x: F.struct(F.lit(False).alias("plus"), x.alias("el"))))
    sized = tried.select("a", "b", "n", "added", "lacking", "near", "label", F.floor((100 - percent) * (F.col("n") + F.floor(100 * F.col("n") / percent)) / (100 + percent)).alias("most"), signed.alias("signed"))
    columns = ["a", "b", "n", "added", "lacking", "near", "label", "at", "el", "plus"]
    near = sized.where("near").select("a", "b", "label", F.explode("signed").alias("e")).select("a", "b", "label", "e.plus", "e.el")
    useful = near.drop("label").join(of_many(near), ["a", "el", "plus"])
    ordered = useful.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("times", "el", "plus"))).alias("us"))  # no more than one document's shingles
    by_rarity = ordered.join(sized.drop("signed"), ["a", "b"]).select("*", F.posexplode("us").alias("i", "u")).withColumn("at", F.col("added") + F.col("lacking") - F.size("us") + F.col("i"))
    by_rarity = by_rarity.where(F.col("at") <= F.col("most")).select("*", "u.el", "u.plus").select(*columns)
    with_far = sized.join(sized.where("NOT near").select("a").distinct(), "a", "left_semi")
    by_hash = with_far.select("*", F.posexplode("signed").alias("at", "e")).where(F.col("at") <= F.col("most")).select("*", "e.el", "e.plus").select(*columns)
    by_hash = by_hash.join(of_many(by_hash).drop("times"), ["a", "el", "plus"]).select(*columns)
    parts = []
    for prefixes, kind in ((by_rarity, "true"), (by_hash, "NOT (x.near AND y.near)")):
        placed = ws.table(prefixes, "prefixes")
        x, y = placed.alias("x"), placed.alias("y")
        on = (F.col("x.a") == F.col("y.a")) & (F.col("x.el") == F.col("y.el")) & (F.col("x.plus") == F.col("y.plus"))
        found = x.join(y, on & (F.col("x.b") < F.col("y.b")) & (F.col("x.label") != F.col("y.label")) & may_be_similar(percent) & F.expr(kind))
        parts.append(found.select(F.col("x.b").alias("a"), F.col("y.b").alias("b")))
    return reduce(DataFrame.unionAll, parts).distinct()


def of_many(elements: DataFrame) -> DataFrame:
    """a, el, plus and times of the elements that members of more than one component have; the others lead nowhere."""
    return elements.groupBy("a", "el", "plus").agg(F.count("*").alias("times"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("a", "el", "plus", "times")


def may_be_similar(percent: int):
    """By the places (at) of a first element in common of x and y, and by their numbers of additions and lacks."""
    allowed = F.floor((100 - percent) * (F.col("x.n") + F.col("y.n")) / (100 + percent))
    rest = lambda t: F.col(f"{t}.added") + F.col(f"{t}.lacking") - F.col(f"{t}.at")
    by_place = F.col("x.at") + F.col("y.at") + F.abs(rest("x") - rest("y")) <= allowed
    return by_place & (F.abs(F.col("x.added") - F.col("y.added")) + F.abs(F.col("x.lacking") - F.col("y.lacking")) <= allowed)


def verified_links(ws: Workspace, stars: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of nodes, enough of them for all components, and the components' labels."""
    others = stars.where("node <> hub")
    one_hub = others.groupBy("node").agg(F.max(F.struct("weight", "hub")).alias("m")).select(F.col("m.hub").alias("a"), F.col("node").alias("b"))
    one_hub = ws.table(one_hub, "first-pairs")
    links = ws.table(compared(one_hub, sets, percent).where("similar").select("a", "b"), "links")
    labels = components(ws, links)
    mixed = ws.table(still_mixed(stars, labels, True).drop("label"), "mixed").where("node <> hub")
    hub_pairs = ws.table(mixed.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.max("members").alias("members")), "hub-pairs")
    if hub_pairs.isEmpty():
        return links, labels
    # members of a group of two have nobody else to be compared with
    alone = ws.table(hub_pairs.where("members = 2").select("a", "b").join(one_hub, ["a", "b"], "left_anti"), "pairs-alone")
    tried = ws.table(compared(ws.table(hub_pairs.where("members > 2").select("a", "b"), "pairs-of-groups"), sets, percent, differences=True), "tried")
    found = [compared(alone, sets, percent).where("similar").select("a", "b"), tried.where("similar").select("a", "b")]
    links = ws.table(reduce(DataFrame.unionAll, [links, *found]).distinct(), "links")
    labels = components(ws, links)
    apart = still_mixed(mixed.where("members > 2").drop("members"), labels, False).select(F.col("hub").alias("a"), F.col("node").alias("b"), "label").distinct()
    rest = ws.table(rest_pairs(ws, ws.table(tried.join(apart, ["a", "b"]), "apart"), percent), "rest-pairs")
    if not rest.isEmpty():
        more = ws.table(compared(rest, sets, percent).where("similar").select("a", "b"), "links")
        if not more.isEmpty():
            links = links.unionAll(more).distinct()
            labels = components(ws, links)
    return links, labels


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows doc_id, text_key, n, node, group and group2, the latter two naming each row's component; and links (a, b) of nodes."""
    spark = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "jaccard")
    ws.sweep()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    indexed = ws.table(keyed.mapInArrow(_index(shingle, percent), f"doc_id {kind}, text_key bigint, n bigint, node bigint, node2 bigint, keys array<bigint>"), "indexed")
    rows = ws.table(indexed.drop("keys"), "rows")
    shared = shared_entries(ws, indexed)
    ws.drop(indexed)
    stars = ws.table(with_hubs(reduce(DataFrame.unionAll, shared)), "stars")
    for t in shared:
        ws.drop(t)
    sets = node_sets(ws, keyed, rows, stars.select("node").distinct(), shingle)
    links, labels = verified_links(ws, stars, sets, percent)
    ws.drop(sets)
    # a node without links is a component by both of its numbers
    named = rows.join(labels, "node", "left")
    return named.select("doc_id", "text_key", "n", "node", F.coalesce("label", "node").alias("group"), F.when(F.col("label").isNull(), F.col("node2")).otherwise(F.lit(0)).alias("group2")), links


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (verified links of the row's node) of every row."""
    named, links = jaccard_groups(docs, shingle, percent)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    least = named.where("n > 0").groupBy("group", "group2").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    least = small(Workspace(docs.sparkSession, "least").table(least, "least"))
    out = named.join(least, ["group", "group2"], "left").join(degree, "node", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("least", "doc_id")).alias("component_id"), F.coalesce("count", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without all but one document of each component: the one with the smallest id (nulls last), then text hash.

    Documents without words stay. Rows with the same id and text as the one that stays are its repetitions and go as well.
    """
    spark = docs.sparkSession
    ws, opened = Workspace(spark, "one-of-each"), Workspace.opened(spark)
    named, _ = jaccard_groups(docs, shingle, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    named = ws.table(named.where("n > 0").select("doc_id", "text_key", "group", "group2", order.alias("o")), "named")
    Workspace.close_since(spark, opened)
    stay = ws.table(named.groupBy("group", "group2").agg(F.min("o").alias("stay"), F.count("*").alias("rows")).where("rows > 1"), "stay")
    multiple = ws.table(named.join(small(stay), ["group", "group2"]).select("doc_id", "text_key", (F.col("o") == F.col("stay")).alias("stays")), "multiple")
    ws.drop(named)
    go = ws.table(multiple.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count("*").alias("times")), "go")
    gone, again = ws.table(go.where("NOT stays OR times > 1"), "out"), ws.table(go.where("stays AND times > 1"), "again")
    for t in (stay, multiple, go):
        ws.drop(t)
    rows = held(docs).alias("r")
    out = rows.join(small(gone).alias("g"), same_row("r", "g"), "left_anti")
    if not again.isEmpty():
        out = out.unionAll(rows.join(small(again).alias("g"), same_row("r", "g"), "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return out.select("row.*")
