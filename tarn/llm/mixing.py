"""Operator 4: mixing sources to target weights, in DataFrame operations alone.

Targets share the total size by the sources' weights, none above max_copies times its source: the excess goes to the other
sources by weight until none is above. Of a source with target t and size s, every document is taken floor(t / s) whole
times; what remains, a share p of the source, is a Pareto order sample. Each document has a random number u from its id,
is ranked by its random odds u / (1 - u) divided by its inclusion odds p / (1 - p), and the lowest ranks are taken until
the words remaining are reached. Then one more document of those not taken, the one whose size comes closest to the words
still missing, closes the gap if that helps.

The place in the rank order where a source is full is found without gathering a source: sizes are summed in RANK_CELLS cells
of the rank for each source, and only documents of the cell where the sum passes the target are ordered one by one.

Null ids are ids like any other, null sources are a source and the last one, null and empty texts have size 0 and are
never sampled beyond their whole copies. Rows that repeat are sampled one by one, ties in rank being broken by size; an
empty table gives no rows. Reruns give the same result, as random numbers are hashes of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import Workspace, same_row, small, words_count

RANK_CELLS = 4096
SEED = "mix-1"
#: Digits of the hash that make a random number; 52 bits, so that it is exact as a double.
HEX = 13
#: Weights of the sources in order of their code points, repeating.
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, max_copies: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of rows (source, source_size), one for each source.

    Raising all targets in proportion to their weights until some reach their caps, and so on, ends where the caps of the
    m sources with the smallest cap for their weight are full and the rest share what is left by weight, for the first m
    at which none of the rest is above its cap. The table has one narrow row for each source.
    """
    everything = Window.partitionBy(F.lit(0))
    number = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_copies)
    before = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("full"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("used"), F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("all_weight"))
    rows = rows.withColumn("left", F.col("total") - F.col("full")).withColumn("share", F.col("all_weight") - F.col("used"))
    # the level of the first row that isn't capped holds for it and for all that follow
    stands = F.col("left") * F.col("weight") <= F.col("cap") * F.col("share")
    rows = rows.withColumn("level", F.min(F.when(stands, F.struct("full", "used", "left", "share"))).over(everything))
    capped = F.col("level").isNull() | (F.col("full") < F.col("level.full")) | (F.col("used") < F.col("level.used"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise((F.col("level.left") * F.col("weight")).cast("double") / F.col("level.share"))
    return rows.select("source", "source_size", target.alias("target"))


def random_number(key: Column) -> Column:
    """In (0, 1), from a hash."""
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, HEX)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(16**HEX)


def same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def sized(docs: DataFrame, *more: Column, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col("source"), words_count(F.col("text")).alias("size"), random_number(F.col(key)).alias("u"), *more)


def ranked(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows of sized(), with what targets have of their source, rank and its cell, which is null for what is never sampled."""
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rank = F.when(F.col("p") <= 0, F.lit(None)).otherwise(odds)
    out = rows.alias("d").join(small(targets).alias("t"), same_source("d", "t")).select("d.*", "source_size", "target", "whole", "rest", rank.alias("rank"))
    cell = F.floor(F.col("rank") / (1 + F.col("rank")) * RANK_CELLS)
    return out.withColumn("cell", F.when(F.col("size") > 0, cell))


def with_edges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows of ranked(), with the cell where their source is full (edge, null if it never is) and the words before it."""
    return rows.alias("d").join(small(edges).alias("e"), same_source("d", "e"), "left").select("d.*", "edge", "before")


def at_edge() -> Column:
    return F.coalesce(F.col("cell") == F.col("edge"), F.lit(False))


def before_edge() -> Column:
    return F.coalesce(F.col("cell").isNotNull() & (F.col("edge").isNull() | (F.col("cell") < F.col("edge"))), F.lit(False))


def drawn(ws: Workspace, docs: DataFrame, max_copies: int, weights: tuple[int, ...], key: str = "doc_id", keep: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written tables: rows of docs with sampled, targets, edges, and the numbers (last) of the rows that close gaps."""
    extra = [keep.alias("kept")] if keep is not None else []
    rows = ws.table(sized(docs, *extra, key=key).withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_copies, weights)
    ratio = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = ws.table(targets.withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0))), "targets")
    placed = ranked(rows, targets)
    # words of each source up to each cell, and the cell where they pass what is wanted
    cells = placed.where("cell IS NOT NULL").groupBy("source", "rest", "cell").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    passed = cells.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("m"))
    passed = ws.table(passed.select("source", F.col("m.cell").alias("edge"), F.col("m.before").alias("before")), "edges")
    placed = with_edges(placed, passed)
    # the documents of those cells, one by one; all others are decided by their cell
    order = Window.partitionBy("source").orderBy("rank", "size", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(order)
    edge = ws.table(placed.where(at_edge()).withColumn("upto", upto).withColumn("sampled", F.col("upto") <= F.col("rest")), "edge-rows")
    reached = edge.where("sampled").groupBy("source").agg(F.max("upto").alias("reached"))
    others = placed.where(~at_edge()).withColumn("sampled", before_edge())
    marked = others.unionByName(edge.drop("upto"))
    # the one that closes the gap
    gaps = passed.alias("a").join(reached.alias("b"), same_source("a", "b"), "left").select("a.source", F.coalesce("reached", "before").alias("reached"))
    marked = marked.alias("d").join(small(ws.table(gaps, "gaps")).alias("g"), same_source("d", "g"), "left").select("d.*", "reached")
    marked = ws.table(marked, "marked")
    ws.drop(rows)
    gap = F.col("rest") - F.col("reached")
    miss = F.abs(F.col("size") - gap)
    last = marked.where(~F.col("sampled") & F.col("cell").isNotNull() & (miss < gap)).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "rank", "size", "doc_id", "row")).alias("m"))
    return marked, targets, passed, ws.table(last.select(F.col("m.row").alias("last")), "last")


def mix(docs: DataFrame, max_copies: int = 3, weights: tuple[int, ...] = WEIGHTS, key: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes: whole copies times size) of every row of docs."""
    marked, _, _, last = drawn(Workspace(docs.sparkSession, "mix"), docs, max_copies, weights, key)
    copies = copies_of(marked, last)
    return copies.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def copies_of(marked: DataFrame, last: DataFrame) -> DataFrame:
    out = marked.join(small(last), F.col("row") == F.col("last"), "left")
    return out.withColumn("copies", F.col("whole") + (F.col("sampled") | F.col("last").isNotNull()).cast("long"))


def mixture(docs: DataFrame, max_copies: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them.

    Texts don't move: a row's cell says how often it is taken. Rows of the cells where a source is full, and those like the
    one that closes a gap, are looked up by id, text hash and source; they are few.
    """
    spark = docs.sparkSession
    ws, opened = Workspace(spark, "mixture"), Workspace.opened(spark)
    marked, targets, edges, last = drawn(Workspace(spark, "mix"), docs, max_copies, weights, keep=F.xxhash64("text"))
    named = marked.select("*", F.col("kept").alias("text_key"))
    closing = named.join(small(last), F.col("row") == F.col("last")).select("doc_id", "text_key", "source").distinct()
    like = same_row("d", "c") & same_source("d", "c")
    singled = named.where(at_edge()).unionAll(named.where(~at_edge()).alias("d").join(F.broadcast(closing.alias("c")), like, "left_semi"))  # a row a source
    copies = copies_of(singled, last).groupBy("doc_id", "text_key", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    copies, targets, edges = ws.table(copies, "copies"), ws.table(targets, "targets"), ws.table(edges, "edges")
    Workspace.close_since(spark, opened)
    rows = sized(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("text_key"))
    found = with_edges(ranked(rows, targets), edges).alias("d").join(small(copies).alias("c"), like, "left")
    once = found.where("c.rows IS NULL OR c.rows = 1").select("d.row", F.coalesce("c.copies", F.col("d.whole") + before_edge().cast("long")).alias("own"))
    again = copies.where("rows > 1")
    if not again.isEmpty():  # rows that repeat share what their id and text are given
        number = F.row_number().over(Window.partitionBy("d.doc_id", "d.text_key", "d.source").orderBy(F.lit(0)))
        many = rows.alias("d").join(small(again).alias("c"), like)
        once = once.unionAll(many.select("d.row", (F.floor(F.col("c.copies") / F.col("c.rows")) + (number <= F.col("c.copies") % F.col("c.rows")).cast("int")).alias("own")))
    return once.select("row", F.explode(F.array_repeat(F.lit(0), F.col("own").cast("int")))).select("row.*")
