"""Arrays, rows, ranges and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.scalar import col


# Arrays: subscripts from 1, NULL where there is nothing --------------------------------------------------------------------
def array_length(a: Column, dimension: int = 1) -> Column:
    if dimension < 1:
        return F.lit(None).cast("int")
    for _ in range(dimension - 1):
        a = F.get(a, F.lit(0))
    return F.when(F.size(a) > 0, F.size(a))


def array_lower(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.lit(1))


def array_upper(a: Column) -> Column:
    return array_length(a)


def array_ndims(kind: str) -> int:
    """Of a type such as array<array<int>>."""
    return kind.count("array<")


def array_dims(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.lit("[1:"), F.size(a).cast("string"), F.lit("]")))


def array_position(a: Column, x, start: int = 1) -> Column:
    """NULL if there is none; NULL searched for matches NULL."""
    found = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.element_at(a, i).eqNullSafe(col(x)) & (i >= start))
    return F.when(F.size(a) > 0, F.get(found, F.lit(0)))


def array_positions(a: Column, x) -> Column:
    return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: F.element_at(a, i).eqNullSafe(col(x))))


def array_to_string(a: Column, separator: str, null: str | None = None) -> Column:
    return F.array_join(a, separator) if null is None else F.array_join(a, separator, null)


def string_to_array(s: Column, separator: str | None) -> Column:
    import re

    return F.split(s, "") if separator is None else F.split(s, re.escape(separator)) if separator else F.array(s)


def array_replace(a: Column, old, new) -> Column:
    return F.transform(a, lambda x: F.when(x.eqNullSafe(col(old)), col(new)).otherwise(x))


def array_remove(a: Column, x) -> Column:
    return F.filter(a, lambda y: ~y.eqNullSafe(col(x)))


def trim_array(a: Column, n: int) -> Column:
    return F.when((F.lit(n) < 0) | (F.lit(n) > F.size(a)), F.raise_error(F.lit("number of elements to trim must be between 0 and the array's length"))).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0))))


def subscript(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i - 1)) if i >= 1 else F.get(a, F.lit(-1))


def array_slice(a: Column, lo: int, hi: int) -> Column:
    lo = max(1, lo)
    return F.slice(a, F.lit(lo), F.lit(max(0, hi - lo + 1)))


def eq_any(x: Column, a: Column) -> Column:
    """x = ANY(a), three-valued."""
    return F.exists(a, lambda y: y == x)


# Ranges: struct (lower, upper, lower_inc, upper_inc); a NULL bound is open ---------------------------------------------------
def make_range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(bounds[0] == "[").alias("lower_inc"), F.lit(bounds[1] == "]").alias("upper_inc"))


def range_empty(r: Column) -> Column:
    return F.coalesce((r["lower"] > r["upper"]) | ((r["lower"] == r["upper"]) & ~(r["lower_inc"] & r["upper_inc"])), F.lit(False))


def range_contains(r: Column, x: Column) -> Column:
    over = r["lower"].isNull() | (x > r["lower"]) | ((x == r["lower"]) & r["lower_inc"])
    under = r["upper"].isNull() | (x < r["upper"]) | ((x == r["upper"]) & r["upper_inc"])
    return over & under


def range_overlaps(a: Column, b: Column) -> Column:
    starts = lambda x, y: x["lower"].isNull() | y["upper"].isNull() | (x["lower"] < y["upper"]) | ((x["lower"] == y["upper"]) & x["lower_inc"] & y["upper_inc"])
    return ~range_empty(a) & ~range_empty(b) & starts(a, b) & starts(b, a)


def range_contains_range(a: Column, b: Column) -> Column:
    low = a["lower"].isNull() | (b["lower"].isNotNull() & ((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))))
    high = a["upper"].isNull() | (b["upper"].isNotNull() & ((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))))
    return range_empty(b) | (~range_empty(a) & F.coalesce(low, F.lit(False)) & F.coalesce(high, F.lit(False)))


# Geometry: points are structs (x, y), boxes structs (low, high), circles structs (center, radius) ---------------------------------
def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(a: Column, b: Column) -> Column:
    return F.struct(point(F.least(a["x"], b["x"]), F.least(a["y"], b["y"])).alias("low"), point(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])).alias("high"))


def box_overlaps(a: Column, b: Column) -> Column:
    return (a["low"]["x"] <= b["high"]["x"]) & (b["low"]["x"] <= a["high"]["x"]) & (a["low"]["y"] <= b["high"]["y"]) & (b["low"]["y"] <= a["high"]["y"])


def box_contains_point(b: Column, p: Column) -> Column:
    return (p["x"] >= b["low"]["x"]) & (p["x"] <= b["high"]["x"]) & (p["y"] >= b["low"]["y"]) & (p["y"] <= b["high"]["y"])


def box_contains_box(a: Column, b: Column) -> Column:
    return box_contains_point(a, b["low"]) & box_contains_point(a, b["high"])


def circle_contains_point(center: Column, radius: Column, p: Column) -> Column:
    return F.pow(p["x"] - center["x"], 2) + F.pow(p["y"] - center["y"], 2) <= F.pow(radius, 2)
