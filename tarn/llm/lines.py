"""Operator 9: fuzzy line deduplication, in DataFrame operations alone.

Texts are cut at line feeds. A line is normalised (lower case; runs of anything but letters and digits become one space) and
lines with equal normal forms are one class. Each class has SKETCHES sketches: the BLOCKS least of its word pairs' hashes, in an
order of its own for each sketch. By the pigeonhole principle, sketches that differ in one block share all the others, so classes
are joined on each sketch without each of its blocks; those of at most SHORT words also on their first and last words, up to
half of them, as one word changed in a short line may change all its sketches. Classes so joined whose SimHashes (60 bits, over
word pairs) differ in at most MAX_BITS bits and whose normal forms have an edit similarity of MIN_SIMILARITY are linked. Of each
connected group, the first occurrence, by doc_id (null first), text hash and line number, is kept and all others go.

SimHashes are made of what is joined alone and spare the edit distance of lines that are far apart; blocks of SimHashes
themselves find few of the pairs (the README has the measured recall).

Members of a key are first compared with a hub, and links are joined into components. A hub, which has met all others, leaves its
key, and keys whose members are then in more than one component take HUBS times as many hubs as before, of the components
with fewest members of the key first, so that a few members that are apart are compared with all the others. A hub is
compared with members of other components alone, and no pair twice. Rounds link the pairs that bounds on the edit distance decide.
When a round links nothing, or few pairs are left, all that is left is compared at once. Of the pairs of all rounds that bounds leave
open, those that are in different components after the last one are then compared as wholes: in the end, any two members of a
key are in one component or have been compared.

Lines without letters or digits stay. Null texts have no lines and stay null; a text all of whose lines go becomes empty.
Rows with the same id and text are one document to this operator: all of them keep the same lines. Columns besides the id
and the text pass through clean() unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import BROADCAST_ROWS, Workspace, held, same_row, small
from tarn.llm.components import components

BITS, LANES, MAX_BITS, MIN_SIMILARITY = 60, 4, 20, 0.9
#: Sketches of a line, and the blocks of each, of 16 bits.
SKETCHES, BLOCKS = 3, 4
#: Lines of at most so many words are also joined on their halves.
SHORT = 24
#: Lines are first compared in chunks of so many characters, the longer ones for lines of more than LONG chunks, each with ANCHOR at its end looked for within SLACK, and after LOST chunks WIDE as far off as the bound allows.
CHUNKS, LONG, ANCHOR, SLACK, LOST, WIDE = (32, 256, 2048), 4, 8, 24, 3, 24
#: By so much the hubs of a key grow from round to round.
HUBS = 4
#: Narrow rows, of which up to so many are broadcast.
NARROW_ROWS = 4 * BROADCAST_ROWS
#: Pairs left are few if they are at most so many times the entries left.
FEW_PAIRS = 4
#: Keys are grouped in so many passes, each over a share of them, so that a pass's shuffle files can go before the next.
PASSES = 4
LANE = BITS // LANES
PART = (1 << LANE - 1) - 1
#: A sketch's order is that of the exclusive or of a pair's hash with one of these, which are spread evenly.
ORDERS = [i * 0x9E3779B97F4A7C15 % (1 << 63) for i in range(SKETCHES)]
SKETCH, HALF = [f"sketch{i}" for i in range(SKETCHES)], [f"half{i}" for i in range(4)]


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no (from 0) and norm, which is empty for lines without letters or digits."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return cut.select("doc_id", "text_key", "line_no", normalised(F.col("line")).alias("norm"))


def pair_hashes(words: Column) -> Column:
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))  # the last word pairs with null


def in_order(x: int):
    return lambda h: h.bitwiseXOR(F.lit(x))


def sketched(lines: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, k1, k2 (a 128-bit name of the normal form), chars, sketches and halves of each line. All of them come from the row itself."""
    keys = ["doc_id", "text_key", "line_no", "k1", "k2", "chars"]
    named = lines.select("doc_id", "text_key", "line_no", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(1), "norm").alias("k2"), F.length("norm").alias("chars"), F.split("norm", " ").alias("words"))
    halved = named.select(*keys, halves(F.col("words")).alias("halves"), F.array_distinct(pair_hashes(F.col("words"))).alias("hashes"))
    ordered = halved.select(*keys, "halves", *(F.sort_array(F.transform("hashes", in_order(x)) if x else "hashes").alias(c) for c, x in zip(SKETCH, ORDERS, strict=True)))
    blocks = lambda c: reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.coalesce(F.get(c, F.lit(i)), F.lit(0)).bitwiseAND(F.lit(0xFFFF)), 16 * i) for i in range(BLOCKS)))
    return ordered.select(*keys, *(blocks(c).alias(c) for c in SKETCH), *(F.get("halves", F.lit(i)).alias(c) for i, c in enumerate(HALF)))


def simhashes(norms: DataFrame) -> DataFrame:
    """node and simhash. norms: node and norm.

    The votes of bit i of each of the four lanes share sum i, in lanes of BITS / LANES bits; comparing all lanes with half of
    the votes is one subtraction. A lane holds PART votes: a longer line is cut into parts of so many word pairs, whose
    SimHashes are combined by exclusive or. All pairs of a line come from one row, so they are summed before the shuffle.
    """
    votes = norms.select("node", F.posexplode(pair_hashes(F.split("norm", " "))).alias("at", "h")).withColumn("part", F.floor(F.col("at") / PART).cast("int"))
    ones = sum(1 << i * LANE for i in range(LANES))
    spread = sum(1 << i * (LANE - 1) for i in range(LANES))
    lanes = lambda i: (F.shiftrightunsigned("h", LANES * i).bitwiseAND(F.lit((1 << LANES) - 1)) * F.lit(spread)).bitwiseAND(F.lit(ones))
    sums = votes.groupBy("node", "part").agg(F.count("*").alias("n"), *(F.sum(lanes(i)).alias(f"s{i}") for i in range(LANE)))
    limit = (F.floor(F.col("n") / 2) * F.lit(ones)).bitwiseOR(F.lit(ones << LANE - 1))
    sums = sums.select("node", limit.alias("limit"), *(F.coalesce(f"s{i}", F.lit(0)).alias(f"s{i}") for i in range(LANE)))
    # a lane's highest bit is gone where its votes are more than half
    won = lambda i: F.shiftleft(F.shiftrightunsigned(F.bitwise_not(F.col("limit") - F.col(f"s{i}")), LANE - 1).bitwiseAND(F.lit(ones)), i)
    return sums.groupBy("node").agg(F.bit_xor(reduce(lambda a, b: a.bitwiseOR(b), map(won, range(LANE)))).alias("simhash"))


def halves(words: Column) -> Column:
    """Hashes of the first and of the last words of a short line, else null. One of them outlives any change to a single word.

    Two lengths, as lines of n and n + 1 words are to share one.
    """
    n = F.size(words)
    hashes = [h for k in (n, n - 1) for p in (F.floor(k / 2).cast("int"),) for h in (F.xxhash64(F.lit(0), F.slice(words, F.lit(1), p)), F.xxhash64(F.lit(1), F.slice(words, n - p + 1, p)))]
    # one word alone is no key: too many lines share it
    return F.when((n >= 5) & (n <= SHORT), F.array(*hashes))


def join_keys() -> Column:
    """An array with keys of each sketch without each of its blocks, and of each half."""
    low = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << 16 * n) - 1))
    without = lambda c, i: F.shiftleft(F.shiftrightunsigned(c, 16 * (i + 1)), 16 * i).bitwiseOR(low(c, i)) if 0 < i < BLOCKS - 1 else low(c, i) if i else F.shiftrightunsigned(c, 16)
    sketches = [without(c, i).bitwiseOR(F.lit(s << 16 * (BLOCKS - 1))) for s, c in enumerate(SKETCH) for i in range(BLOCKS)]
    return F.concat(F.array(*sketches), F.when(F.col(HALF[0]).isNotNull(), F.array(*HALF)).otherwise(F.array().cast("array<bigint>")))


def _as_long(a: str, b: str) -> Column:
    return F.least(f"{a}.chars", f"{b}.chars") >= F.greatest(f"{a}.chars", f"{b}.chars") * MIN_SIMILARITY


def with_norms(pairs: DataFrame, norms: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, with their normal forms x and y, and most: the edit distance they may have. norms: node and norm.

    Where pairs are counted to be few enough, they are sent to the normal forms, and only the forms they name move.
    """
    x, y = norms.select(F.col("node").alias("a"), F.col("norm").alias("x")), norms.select(F.col("node").alias("b"), F.col("norm").alias("y"))
    few = pairs.limit(NARROW_ROWS + 1).count() <= NARROW_ROWS
    if few:
        y = y.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    two = x.join(F.broadcast(pairs) if few else pairs, "a").join(y, "b")
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * (1 - MIN_SIMILARITY) + 1e-9).cast("int")
    return two.select("a", "b", "x", "y", most.alias("most"))


def tested(pairs: DataFrame, norms: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, with near: whether bounds say that they are alike, or null where they don't say."""
    return with_norms(pairs, norms).select("a", "b", F.expr(bounded("x", "y", "most")).getField("near").alias("near"))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are in different components."""
    known = small(labels, NARROW_ROWS)
    ends = pairs.join(known.toDF("a", "la"), "a", "left").join(known.toDF("b", "lb"), "b", "left")
    return ends.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def linked_wholes(ws: Workspace, pairs: DataFrame, norms: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), a written table, that are alike, by the edit distance of wholes.

    They are dealt out evenly, as each takes long. That is written down: Spark would take a filter by distance before the
    exchange, and before any join that spares it pairs.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ws.table(with_norms(pairs, norms).repartition(n, "a", "b"), "wholes")
    found = ws.table(dealt.where(F.expr(whole("x", "y", "most"))).select("a", "b"), "links")
    ws.drop(dealt)
    return found


def core(x: str, y: str) -> str:
    """A struct of x and y without most of what they begin and end with in common; their edit distance is the same.

    Halves, quarters and so on of the shorter one are taken off as long as they are equal.
    """
    size = lambda a, b: f"least(length({a}), length({b}))"
    part = lambda s, f: f"substring({s}, at + 1, {size(x, y)} div {f})"
    head = f"aggregate(array(2, 4, 8, 16, 32, 64), 0, (at, f) -> at + CASE WHEN {part(x, 'f')} = {part(y, 'f')} THEN int({size(x, y)} div f) ELSE 0 END)"
    cut = f"transform(array({head}), n -> struct(substring({x}, n + 1) AS x, substring({y}, n + 1) AS y))[0]"
    end = lambda s: f"substring(r.{s}, length(r.{s}) - at - int({size('r.x', 'r.y')} div f) + 1, int({size('r.x', 'r.y')} div f))"
    tail = f"aggregate(array(2, 4, 8, 16, 32, 64), 0, (at, f) -> at + CASE WHEN {end('x')} = {end('y')} THEN int({size('r.x', 'r.y')} div f) ELSE 0 END)"
    return f"transform(array({cut}), r -> transform(array({tail}), n -> struct(substring(r.x, 1, length(r.x) - n) AS x, substring(r.y, 1, length(r.y) - n) AS y))[0])[0]"


def no_less(x: str, y: str, most: str, chunk: int) -> str:
    """An upper bound on the edit distance of x and y in a time that grows with their length, or some number above `most`.

    x is cut into chunks. A chunk's last ANCHOR characters are looked for in y at most SLACK characters off where they should
    be, and y is cut behind them; where they aren't found, the next chunk is taken with this one. After LOST of them its last WIDE
    characters are looked for at most `most` off, as there may be a passage in one of the lines alone, and after eight y is
    cut where x is. Distances of pieces of the same place sum to no less than that of the wholes; they aren't taken beyond
    what is left of `most`.
    """
    end = f"(i * {chunk})"
    left = f"({most} - s.sum)"
    limited = f"coalesce(nullif(levenshtein(r.a, r.b, {left}), -1), {left} + 1)"
    distance = lambda a, b: f"transform(array(struct({a} AS a, {b} AS b)), r -> CASE WHEN r.a = r.b THEN 0 WHEN length(r.a) > 2 * {left} THEN {limited} ELSE levenshtein(r.a, r.b) END)[0]"
    found = f"locate(substring({x}, {end} - {ANCHOR - 1}, {ANCHOR}), substring({y}, s.py + 1, {end} - s.px + {SLACK}), greatest(1, {end} - s.px - {SLACK + ANCHOR}))"
    wide = f"locate(substring({x}, {end} - {WIDE - 1}, {WIDE}), substring({y}, s.py + 1, {end} - s.px + {most}), greatest(1, {end} - s.px - {WIDE} - {most}))"
    lost = f"transform(array({wide}), w -> CASE WHEN w > 0 THEN w + {WIDE - 1} WHEN {end} - s.px >= 8 * {chunk} THEN {end} - s.px END)[0]"
    taken = f"CASE WHEN q > 0 THEN q + {ANCHOR - 1} WHEN {end} - s.px >= {LOST} * {chunk} THEN {lost} END"
    piece = distance(f"substring({x}, s.px + 1, {end} - s.px)", f"substring({y}, s.py + 1, n)")
    step = f"transform(array({found}), q -> transform(array({taken}), n -> CASE WHEN n IS NULL THEN s ELSE struct({end} AS px, s.py + n AS py, s.sum + {piece} AS sum) END)[0])[0]"
    rest = distance(f"substring({x}, s.px + 1)", f"substring({y}, s.py + 1)")
    start = "struct(0 AS px, 0 AS py, 0 AS sum)"
    return f"aggregate(sequence(1, greatest(1, int(length({x}) / {chunk}))), {start}, (s, i) -> CASE WHEN s.sum > {most} OR {end} > length({x}) THEN s ELSE {step} END, s -> CASE WHEN s.sum > {most} THEN s.sum ELSE s.sum + {rest} END)"


def bounded(x: str, y: str, most: str) -> str:
    """A struct of near: whether the edit distance of x and y is at most `most`, or null where bounds don't say.

    Where wholes have an edit distance of d and lengths that differ by n, equally long beginnings, and ends, have one of at most
    d + n, and less is compared; an upper bound that is within `most` decides as well.
    """
    apart = f"({most} + abs(length(c.x) - length(c.y)))"
    far_apart = [f"levenshtein({end}(c.x, 2 * {apart} + 16), {end}(c.y, 2 * {apart} + 16), {apart}) < 0" for end in ("left", "right")]
    far_apart = f"least(length(c.x), length(c.y)) > 4 * {apart} + {LONG * max(CHUNKS)} AND ({' OR '.join(far_apart)})"
    within = " ".join(f"WHEN length(c.x) >= {LONG * n if n > min(CHUNKS) else 0} AND {no_less('c.x', 'c.y', most, n)} <= {most} THEN true" for n in CHUNKS)
    cores = f"transform(array({core(x, y)}), c -> CASE {within} WHEN {far_apart} THEN false END)[0]"
    long_ = f"length({x}) >= {LONG * CHUNKS[1]}"  # of shorter ones, cores take longer than they spare
    return f"struct(CASE WHEN abs(length({x}) - length({y})) > {most} THEN false WHEN {long_} THEN {cores} WHEN {no_less(x, y, most, CHUNKS[0])} <= {most} THEN true END AS near)"


def whole(x: str, y: str, most: str) -> str:
    """Whether the edit distance of x and y is at most `most`, by their cores. It takes time in the square of a length."""
    return f"transform(array({core(x, y)}), c -> levenshtein(c.x, c.y, {most}) >= 0)[0]"


def alike(x: str, y: str, most: str) -> Column:
    """Whether the edit distance of x and y is at most `most`; that of wholes is taken only where bounds leave it open."""
    return F.expr(f"coalesce({bounded(x, y, most)}.near, {whole(x, y, most)})")


def norms_of(ws: Workspace, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and norm of nodes (node, first), from their first occurrences."""
    where = ws.table(nodes.select("node", F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("tk"), F.col("first.line_no").alias("no")), "first")
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    texts = cut.join(small(where, NARROW_ROWS), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("tk")) & (F.col("line_no") == F.col("no")))
    return ws.table(texts.select("node", "line").dropDuplicates(["node"]).select("node", normalised(F.col("line")).alias("norm")), "norms")


def shared_keys(ws: Workspace, classes: DataFrame) -> DataFrame:
    """key, node, chars of the keys that more than one class has."""
    entries = classes.select("node", "chars", F.explode(join_keys()).alias("key"))
    parts = []
    for i in range(PASSES):
        some = entries.where(F.pmod("key", F.lit(PASSES)) == i)
        groups = ws.table(some.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key"), "groups")
        parts.append(ws.table(some.join(small(groups, NARROW_ROWS), "key"), "members"))
        ws.drop(groups)
    return reduce(DataFrame.unionAll, parts)


def hubs_of(known: DataFrame, most: int) -> DataFrame:
    """key, hub, hub_chars, hub_label and hub_simhash: of each key at most so many members, those of small components first."""
    size = F.lit(1)
    if most > 1:  # before the first round, each member is a component
        known, size = known.join(known.groupBy("key", "label").agg(F.count("*").alias("size")), ["key", "label"]), F.col("size")
    order = Window.partitionBy("key").orderBy(size, F.xxhash64("node"), "node")
    return as_hubs(known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most))


def as_hubs(known: DataFrame) -> DataFrame:
    return known.select("key", F.col("node").alias("hub"), F.col("chars").alias("hub_chars"), F.col("label").alias("hub_label"), F.col("simhash").alias("hub_simhash"))


def met(known: DataFrame, hubs: DataFrame, once: bool) -> DataFrame:
    """Members (known) with hubs of their keys that may be alike. once: a member meets a hub at the least of the keys where it could.

    In the first round, each key has one hub and few meet at two keys; later, members of frequent keys share most of them.
    """
    if once:
        known = known.join(known.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")  # at most as many as join_keys() has
        hubs = hubs.join(hubs.groupBy("hub").agg(F.collect_set("key").alias("hub_keys")), "hub")
    pairs = known.join(hubs, "key").where("label <> hub_label").where(F.least("chars", "hub_chars") >= F.greatest("chars", "hub_chars") * MIN_SIMILARITY)
    pairs = pairs.where(F.bit_count(F.col("simhash").bitwiseXOR(F.col("hub_simhash"))) <= MAX_BITS)
    return pairs.where("key = array_min(array_intersect(keys, hub_keys))") if once else pairs


def merged(ws: Workspace, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node and label of components, after further links (a, b): the components they join are joined."""
    if labels is None:
        return components(ws, links)
    known = small(labels, NARROW_ROWS)
    ends = links.join(known.toDF("a", "la"), "a", "left").join(known.toDF("b", "lb"), "b", "left")
    new = components(ws, ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    moved = labels.join(small(new, NARROW_ROWS).toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return ws.table(moved.unionAll(new.join(known, "node", "left_anti").select("node", "label")), "merged")


def labels_by_rounds(ws: Workspace, members: DataFrame, norms: DataFrame) -> DataFrame:
    """Components' labels (node, label) of the links among members (key, node, chars, simhash); see the module's account of hubs."""
    known = ws.table(members.withColumn("label", F.col("node")), "known")
    tried, labels, most = None, None, 1
    while known is not None:
        hubs = ws.table(hubs_of(known, most), "hubs") if most else as_hubs(known)
        pairs = met(known, hubs, tried is not None)
        if not most:
            pairs = pairs.where("node < hub")  # each of them is a hub to the other
        pairs = pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        pairs = ws.table(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        verdicts = ws.table(tested(pairs, norms), "tested")
        ws.drop(pairs)
        tried = verdicts if tried is None else tried.unionAll(verdicts)
        found = verdicts.where("near").select("a", "b")
        linking = not found.isEmpty()
        if linking or labels is None:
            labels = merged(ws, labels, found)
        known, most = left_of(ws, known, hubs, labels, most, linking) if most else (None, 0)
    unsure = ws.table(apart(tried.where("near IS NULL"), labels), "unsure")
    return merged(ws, labels, linked_wholes(ws, unsure, norms))


def left_of(ws: Workspace, known: DataFrame, hubs: DataFrame, labels: DataFrame, most: int, linking: bool) -> tuple[DataFrame | None, int]:
    """What a round leaves of known: the members, without hubs, of keys in more than one component, or None; and how many hubs the next round takes, 0 for all."""
    rest = known.join(hubs.select("key", F.col("hub").alias("node")), ["key", "node"], "left_anti")
    if linking:
        rest = rest.withColumnRenamed("label", "own").join(small(labels, NARROW_ROWS), "node", "left").withColumn("label", F.coalesce("label", "own")).drop("own")
    rest = ws.table(rest.select("key", "node", "chars", "simhash", "label"), "rest")
    mixed = ws.table(rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"), "mixed")
    left = mixed.agg(F.sum("n").alias("entries"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")).first()
    if not left.entries:
        return None, 0
    ws.drop(known)
    out = ws.table(rest.join(small(mixed.select("key"), NARROW_ROWS), "key"), "known")
    ws.drop(rest)
    return out, most * HUBS if linking and left.pairs > FEW_PAIRS * left.entries else 0


def occurrences_to_drop(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and line_no of every line that an earlier line of its group makes superfluous."""
    ws = Workspace(docs.sparkSession, "lines")
    rows = ws.table(sketched(lines_of(docs)), "lines").where("chars > 0")  # a filter before the table would normalise each line twice
    place = F.struct("doc_id", "text_key", "line_no")
    classes = rows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("chars", *SKETCH, *HALF)))
    classes = ws.table(classes.withColumn("node", F.col("k1")), "classes")
    members = shared_keys(ws, classes)
    norms = norms_of(ws, docs, classes.select("node", "first").join(members.select("node").distinct(), "node", "left_semi"))
    labels = labels_by_rounds(ws, members.join(simhashes(norms), "node"), norms)
    # classes that are more than one line, and the first line of their groups
    grouped = classes.join(labels, "node", "left").where("n > 1 OR label IS NOT NULL")
    grouped = grouped.select("k1", "k2", "first", F.coalesce("label", "k1").alias("g1"), F.when(F.col("label").isNull(), F.col("k2")).otherwise(F.lit(0)).alias("g2"))
    kept = ws.table(grouped.groupBy("g1", "g2").agg(F.min("first").alias("kept")), "kept")
    grouped = ws.table(grouped.join(small(kept), ["g1", "g2"]).select("k1", "k2", "kept"), "groups")
    return rows.join(small(grouped), ["k1", "k2"]).where(~place.eqNullSafe(F.col("kept"))).select("doc_id", "text_key", "line_no")


def dropped_by_doc(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the sorted numbers of the lines to drop, of documents that have any. A list is as long as one text has lines."""
    return occurrences_to_drop(docs).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def drops_of(docs: DataFrame) -> DataFrame:
    """dropped_by_doc() as a table; all others of this job are deleted."""
    ws, opened = Workspace(docs.sparkSession, "drops"), Workspace.opened(docs.sparkSession)
    drops = ws.table(dropped_by_doc(docs), "drops")
    Workspace.close_since(docs.sparkSession, opened)
    return drops


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped (numbers of lines, comma-joined) of every row."""
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), n_lines.cast("long").alias("n_lines")).alias("r")
    out = rows.join(drops_of(docs).alias("d"), same_row("r", "d"), "left")
    return out.select("r.doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def clean(docs: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """docs with the dropped lines taken out of text; all columns as they were. Without keep_emptied, documents go of which no letter or digit is left so."""
    out = held(docs).alias("r").join(small(drops_of(docs), 20_000).alias("d"), same_row("r", "d"), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains(F.col("dropped"), i)), "\n")
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(kept)
    if not keep_emptied:
        out = out.where(F.col("dropped").isNull() | kept.rlike(r"[\p{L}\p{N}]"))
    return out.select(*((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
