"""Casts of text that differ from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _else_error(ok: Column, value: Column, s: Column, kind: str) -> Column:
    return F.when(s.isNull(), None).when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"invalid input syntax for type {kind}: "), s)))


def to_boolean(s: Column) -> Column:
    """Unique prefixes of true, false, yes, no, on and off; 1 and 0."""
    t = F.lower(F.trim(s))
    yes, no = ("t", "tr", "tru", "true", "y", "ye", "yes", "on", "1"), ("f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0")
    return _else_error(t.isin(*yes, *no), t.isin(*yes), s, "boolean")


def to_uuid(s: Column) -> Column:
    """Lower case with dashes; braces and missing dashes are allowed."""
    hexes = F.regexp_replace(F.lower(s), r"^\{|\}$|-", "")
    text = F.regexp_replace(hexes, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return _else_error(hexes.rlike("^[0-9a-f]{32}$"), text, s, "uuid")


def to_money(s: Column) -> Column:
    """decimal(19,2): dollar signs and thousands separators are dropped, parentheses are minus."""
    body = F.regexp_replace(s, r"[$,()\s]", "")
    negative = s.rlike(r"^\s*\(.*\)\s*$")
    value = body.try_cast("decimal(21,4)").cast("decimal(19,2)")
    return _else_error(body.try_cast("decimal(21,4)").isNotNull(), F.when(negative, -value).otherwise(value), s, "money")


def to_numeric(s: Column, precision: int = 38, scale: int = 10) -> Column:
    return s.cast(f"decimal({precision},{scale})")


def to_json_checked(s: Column) -> Column:
    return _else_error(F.try_parse_json(s).isNotNull(), s, s, "json")


def to_jsonb(s: Column) -> Column:
    return F.parse_json(s)


def to_text(x: Column, boolean: bool = False) -> Column:
    return F.when(x, "true").when(~x, "false") if boolean else x.cast("string")


def bpchar_equal(a: Column, b: Column) -> Column:
    """CHAR comparison: trailing blanks don't count."""
    return F.rtrim(a) == F.rtrim(b)


def enum_ordinal(x: Column, labels: list[str]) -> Column:
    """The place of an enum's label in its declaration, from 1; for comparison and order."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), x), F.lit(0))


def domain(x: Column, check, name: str) -> Column:
    """x, or an error where check(x) is false."""
    return F.when(F.coalesce(check(x), F.lit(True)), x).otherwise(F.raise_error(F.lit(f"value violates check of domain {name}")))


def timetz(s: Column) -> Column:
    """struct (micros since midnight, offset in seconds) of text such as 12:34:56+02."""
    group = lambda i: F.regexp_extract(s, r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?\s*(?:([-+])(\d{1,2})(?::?(\d{2}))?|Z)?$", i)
    number = lambda i: F.coalesce(F.nullif(group(i), F.lit("")).cast("long"), F.lit(0))
    us = (number(1) * 3600 + number(2) * 60 + number(3)) * 1_000_000 + F.coalesce(F.nullif(F.rpad(group(4), 6, "0"), F.lit("000000")).try_cast("long"), F.lit(0))
    offset = (number(6) * 3600 + number(7) * 60) * F.when(group(5) == "-", -1).otherwise(1)
    return F.when(s.isNotNull(), F.struct(us.alias("micros"), offset.cast("int").alias("offset")))
