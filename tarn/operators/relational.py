"""Relational operators that Spark's API lacks or spells differently."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.workspace import Workspace

MOST_ROUNDS = 1024


def order(*names: str) -> list[Column]:
    """Sort keys with nulls last when ascending and first when descending; a minus sign means descending."""
    return [F.col(n[1:]).desc_nulls_first() if n.startswith("-") else F.col(n).asc_nulls_last() for n in names]


def distinct_on(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The first row of each key in an order. Spark limits each task's groups to their first rows before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def pivot(df: DataFrame, column: str, values: list, aggregates: dict[str, Column], groups: list[str] | None = None) -> DataFrame:
    """Groups are all other columns unless given; gaps of counts are 0, of others NULL; a NULL in the pivot column is no value.

    aggregates: name to an aggregate; their names follow the values' unless there is just one.
    """
    used = set(groups) if groups is not None else set(df.columns) - {column} - _inputs(aggregates)
    keep = [c for c in df.columns if c in used]
    out = df.groupBy(*keep).pivot(column, values).agg(*(a.alias(k) for k, a in aggregates.items()))
    counts = [k for k, a in aggregates.items() if str(a._jc).lower().startswith("count")]
    zero = [f"{v}_{k}" if len(aggregates) > 1 else f"{v}" for v in values for k in counts]
    return out.fillna(0, zero) if zero else out


def _inputs(aggregates: dict[str, Column]) -> set[str]:
    import re

    return {w for a in aggregates.values() for w in re.findall(r"\w+", str(a._jc))}


def unpivot(df: DataFrame, columns: list[str], name: str, value: str, include_nulls: bool = False) -> DataFrame:
    """Rows (others, name, value); NULL values are left out unless included."""
    out = df.unpivot([c for c in df.columns if c not in columns], columns, name, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())


def recursive_union(spark: SparkSession, start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """WITH RECURSIVE ... UNION: step is applied to what is new until nothing is. Every round is a written table."""
    ws = Workspace(spark, "recursive")
    new = ws.table(start.distinct())
    seen = new
    for _ in range(MOST_ROUNDS):
        if new.isEmpty():
            return seen
        found = step(new).toDF(*seen.columns).distinct()
        same = reduce(lambda a, b: a & b, (F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in seen.columns))
        new = ws.table(found.alias("f").join(seen.alias("s"), same, "left_anti"))
        seen = seen.unionAll(new)
    raise RuntimeError(f"a recursion of more than {MOST_ROUNDS} rounds")


def merge(target: DataFrame, source: DataFrame, keys: list[str], clauses: list[tuple]) -> DataFrame:
    """The target after MERGE. Clauses apply in order, the first that fits wins:

    ("matched", condition or None, {column: value} or "delete"), ("not matched", condition or None, {column: value}),
    ("not matched by source", condition or None, {column: value} or "delete"). Conditions and values see t.* and s.*.
    Two source rows for one target row are an error.
    """
    # counted, not windowed, so that null keys don't meet in one task
    many = source.groupBy(*keys).agg(F.count("*").alias("__many")).where("__many > 1")
    s = source.join(many, keys, "left").withColumn("__s", F.lit(True))
    t = target.withColumn("__t", F.lit(True))
    both = reduce(lambda a, b: a & b, (F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys))
    j = t.alias("t").join(s.alias("s"), both, "full")
    here = {"matched": F.col("__t").isNotNull() & F.col("__s").isNotNull(), "not matched": F.col("__t").isNull(), "not matched by source": F.col("__s").isNull()}
    kept = F.col("__t").isNotNull()
    values = {c: F.when(F.col("__t").isNotNull(), F.col(f"t.{c}")) for c in target.columns}
    for kind, condition, action in reversed(clauses):
        fits = here[kind] if condition is None else here[kind] & F.coalesce(condition, F.lit(False))
        kept = F.when(fits, F.lit(action != "delete")).otherwise(kept)
        if action != "delete":
            for c in target.columns:
                new = action.get(c, F.col(f"t.{c}") if kind != "not matched" else F.lit(None))
                values[c] = F.when(fits, new).otherwise(values[c])
    bad = (F.col("__many") > 1) & here["matched"]
    checked = F.when(bad, F.raise_error(F.lit("MERGE would change a row twice")).cast("boolean")).otherwise(kept)
    return j.where(checked).select(*(values[c].cast(target.schema[c].dataType).alias(c) for c in target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: bool = True, values: dict[str, Column] | None = None, order: list[Column] | None = None, returning: bool = False) -> DataFrame:
    """The target after INSERT ... ON CONFLICT (keys) DO UPDATE, or DO NOTHING; or, with returning, the rows inserted or updated.

    values: what DO UPDATE sets, of t.* (the row that is there) and s.* (the new one); all columns of the new row by default.
    Rows whose key isn't null and repeats: DO UPDATE is an error; DO NOTHING keeps the first in the given order (else any one).
    Null keys conflict with nothing.
    """
    columns = target.columns
    row, known = F.struct(*columns), reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    first = F.min_by(row, F.struct(*order)) if order else F.first(row)
    unique = rows.where(known).groupBy(*keys).agg(first.alias("row"), F.count("*").alias("n"))
    if update:
        again = F.raise_error(F.lit("ON CONFLICT DO UPDATE would change a row twice")).cast("boolean")
        unique = unique.where(F.when(F.col("n") > 1, again).otherwise(F.lit(True)))
    s = unique.select("row.*").unionByName(rows.where(~known).select(*columns)).withColumn("__s", F.lit(True))
    both = reduce(lambda a, b: a & b, (F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys))
    j = target.withColumn("__t", F.lit(True)).alias("t").join(s.alias("s"), both, "full")
    old, new = F.col("__t").isNotNull(), F.col("__s").isNotNull()
    changed = {c: F.col(f"t.{c}") if not update else F.col(f"s.{c}") if values is None else values.get(c, F.col(f"t.{c}")) for c in columns}
    if returning:
        j = j.where(new if update else new & ~old)
    return j.select(*(F.when(old & new, changed[c]).when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) for c in columns))


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    fits = F.coalesce(where, F.lit(False))
    return df.select(*(F.when(fits, values[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns))


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """Inclusive; a negative step descends; 0 is an error."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    n = max(0, (stop - start) // step + 1)
    return spark.range(n).select((F.col("id") * step + start).alias("generate_series"))


def unnest(df: DataFrame, array: Column, name: str = "unnest") -> DataFrame:
    return df.select("*", F.explode(array).alias(name))


def json_each(df: DataFrame, doc: str) -> DataFrame:
    """df's columns with key and value (JSON text) of each member."""
    return df.select("*", F.explode(F.from_json(doc, "map<string,variant>")).alias("key", "__value")).withColumn("value", F.to_json("__value")).drop("__value")


def tenant_view(df: DataFrame, column: str, tenant) -> DataFrame:
    """Rows of one tenant, as a row-security policy would show them."""
    return df.where(F.col(column) == F.lit(tenant))


def ranked(df: DataFrame, name: str, by: list[Column]) -> DataFrame:
    """df with its rows' numbers from 1 in an order, by ranges: numbers within a range, and the counts of the ranges before it.

    Which range a row is in is written down, as ranges come from a sample.
    """
    spark = df.sparkSession
    rows = Workspace(spark, "ranked").table(df.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))  # a row a range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__range", before.alias("__before"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    return rows.withColumn("__local", local).join(F.broadcast(offsets), "__range").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__before") + F.col("__local")).alias(name))


def quantiles(df: DataFrame, keys: list[str], cuts: dict[str, tuple[str, str, float]]) -> DataFrame:
    """keys and, by name, quantiles of double columns: (kind, column, fraction), of kind cont or disc. Exact; nulls don't count.

    Values are counted and dealt out by ranges, and each range knows the counts of those before it, so that only the ranges
    that hold a quantile are looked into and no task has all values of a group.
    """
    ws = Workspace(df.sparkSession, "quantiles")
    columns = list(dict.fromkeys(c for _, c, _ in cuts.values()))
    rows = df.select(F.struct(*keys).alias("g"), F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).alias("x")) for i, c in enumerate(columns)))).alias("v"))
    counts = rows.where("v.x IS NOT NULL").groupBy("g", "v.c", "v.x").agg(F.count("*").alias("n"))
    ranges = ws.table(counts.repartitionByRange("g", "c", "x").withColumn("range", F.spark_partition_id()), "ranges")
    group = Window.partitionBy("g", "c")
    before = F.coalesce(F.sum("n").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranges.groupBy("g", "c", "range").agg(F.sum("n").alias("n")).select("*", before.alias("before"), F.sum("n").over(group).alias("total"))
    # the places, from 0, of the values that a quantile is made of
    at = {k: F.col("total") * f - 1 if kind == "disc" else (F.col("total") - 1) * f for k, (kind, _, f) in cuts.items()}
    place = {k: F.greatest(F.ceil(p), F.lit(0)) if cuts[k][0] == "disc" else F.floor(p) for k, p in at.items()}
    ends = [F.struct(F.lit(columns.index(cuts[k][1])).alias("c"), F.lit(k).alias("name"), F.lit(e).alias("end"), (F.ceil(at[k]) if e else place[k]).alias("place"), at[k].cast("double").alias("at")) for k in cuts for e in ((0, 1) if cuts[k][0] == "cont" else (0,))]
    asked = parts.withColumn("e", F.explode(F.array(*ends))).where("c = e.c AND e.place >= before AND e.place < before + n")
    asked = ws.table(asked.select(F.col("g").alias("ag"), F.col("range").alias("arange"), F.col("c").alias("ac"), "before", "e.name", "e.end", "e.place", "e.at"), "asked")
    held = ranges.join(asked.select("ag", "arange", "ac", "before").distinct(), F.col("g").eqNullSafe(F.col("ag")) & (F.col("range") == F.col("arange")) & (F.col("c") == F.col("ac")))
    upto = held.select("g", "c", "range", "x", "n", (F.col("before") + F.sum("n").over(Window.partitionBy("g", "c", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).alias("upto"))
    found = upto.join(asked, F.col("g").eqNullSafe(F.col("ag")) & (F.col("range") == F.col("arange")) & (F.col("c") == F.col("ac"))).where("place < upto AND place >= upto - n")
    one = lambda k, e, x: F.max(F.when((F.col("name") == k) & (F.col("end") == e), F.col(x)))
    made = {}
    for k, (kind, _, _) in cuts.items():
        low, high, where = one(k, 0, "x"), one(k, 1, "x"), one(k, 0, "at")
        made[k] = low if kind == "disc" else F.when(low == high, low).otherwise((F.ceil(where) - where) * low + (where - F.floor(where)) * high)
    values = found.groupBy(F.col("g").alias("vg")).agg(*(c.alias(k) for k, c in made.items()))
    groups = df.select(F.struct(*keys).alias("g")).distinct().join(values, F.col("g").eqNullSafe(F.col("vg")), "left")
    return groups.select(*(F.col(f"g.`{k}`") for k in keys), *cuts)


def numbered(df: DataFrame, name: str, start: int = 1, step: int = 1, by: list[Column] | None = None) -> DataFrame:
    """A sequence's values, gap-free in an order, or by partition and place without one."""
    if by:
        return ranked(df, name, by).withColumn(name, ((F.col(name) - 1) * step + start).cast("long"))
    return df.withColumn(name, (F.monotonically_increasing_id() * step + start).cast("long"))

