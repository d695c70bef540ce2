"""Conditional, numeric, string and bit-string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Conditional ------------------------------------------------------------------------------------------------------------
def nvl(a: Column, b) -> Column:
    return F.coalesce(a, col(b))


def nullif(a: Column, b) -> Column:
    return F.when(a == col(b), None).otherwise(a)


def is_distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def is_true(a: Column, want: bool = True, negated: bool = False) -> Column:
    out = a.eqNullSafe(F.lit(want))
    return ~out if negated else out


def scalar_min(*xs: Column) -> Column:
    """Of two or more arguments; NULL if any is, unlike least()."""
    return F.when(_any_null(xs), None).otherwise(F.least(*xs))


def scalar_max(*xs: Column) -> Column:
    return F.when(_any_null(xs), None).otherwise(F.greatest(*xs))


def _any_null(xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | x.isNull()
    return out


# Numbers ----------------------------------------------------------------------------------------------------------------
def int_divide(a: Column, b: Column) -> Column:
    """Truncates towards zero; division by zero is an error."""
    return F.call_function("div", a, b)


def round_double(x: Column) -> Column:
    """Half to even."""
    return F.rint(x)


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def log(x: Column, base: Column | None = None) -> Column:
    """Base 10 with one argument; log(base, x) with two."""
    return F.log10(x) if base is None else F.log(x) / F.log(base)


# Strings ----------------------------------------------------------------------------------------------------------------
def trim(s: Column) -> Column:
    """All white space at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def left(s: Column, n: int) -> Column:
    """Negative n: all but the last -n."""
    return F.substring(s, F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """Negative n: all but the first -n."""
    if n >= 0:
        return F.when(F.length(s) <= n, s).otherwise(F.substring(s, F.length(s) - n + 1, F.lit(n)))
    return F.substring(s, F.lit(1 - n), F.length(s))


def substring(s: Column, start: int, length: int | None = None) -> Column:
    """A start before 1 shortens the length."""
    if length is None:
        return F.substring(s, F.lit(max(1, start)), F.length(s))
    if length < 0:
        raise ValueError("negative substring length")
    end = start + length
    return F.substring(s, F.lit(max(1, start)), F.lit(max(0, end - max(1, start))))


def concat(*xs: Column, booleans: tuple[int, ...] = ()) -> Column:
    """Skips NULL; arguments whose numbers are in booleans print t or f."""
    parts = [F.when(x, "t").when(~x, "f") if i in booleans else x.cast("string") for i, x in enumerate(xs)]
    return F.concat_ws("", *parts)


def split_part(s: Column, separator: str, field: int) -> Column:
    if field <= 0:
        raise ValueError("field position must be greater than zero")
    return F.split_part(s, F.lit(separator), F.lit(field))


def quote_literal(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_ident(s: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))


def format_text(pattern: str, *xs: Column) -> Column:
    """%s, %I, %L and %%."""
    parts, args, i = [], iter(xs), 0
    while i < len(pattern):
        at = pattern.find("%", i)
        if at < 0:
            parts.append(F.lit(pattern[i:]))
            break
        if at > i:
            parts.append(F.lit(pattern[i:at]))
        kind = pattern[at + 1 : at + 2]
        if kind == "%":
            parts.append(F.lit("%"))
        elif kind in ("s", "I", "L"):
            x = next(args).cast("string")
            parts.append({"s": F.coalesce(x, F.lit("")), "I": quote_ident(x), "L": F.coalesce(quote_literal(x), F.lit("NULL"))}[kind])
        else:
            raise ValueError(f"unknown format %{kind}")
        i = at + 2
    return F.concat(*parts) if parts else F.lit("")


def regexp_replace(s: Column, pattern: str, to: str, flags: str = "") -> Column:
    """The first match only, unless flags has g; i and m as usual. In `to`, \\1 to \\9 are groups and \\& is the match."""
    import re

    inline = "".join(f"(?{f})" for f in flags if f in "im")
    shift = 0 if "g" in flags else 1  # a group of ours comes first
    quoted = to.replace("$", "\\$")
    quoted = re.sub(r"\\([1-9])", lambda m: f"${int(m[1]) + shift}", quoted)
    if "g" in flags:
        return F.regexp_replace(s, inline + pattern, quoted.replace(r"\&", "$0"))
    return F.regexp_replace(s, rf"{inline}\A([\s\S]*?)(?:{pattern})", "$1" + quoted)


def md5(s: Column) -> Column:
    return F.md5(s.cast("binary"))


def sha256(s: Column) -> Column:
    return F.sha2(s.cast("binary"), 256)


# Bit strings: text of 0 and 1 --------------------------------------------------------------------------------------------
def bit_count(bits: Column) -> Column:
    return F.length(F.replace(bits, F.lit("0"), F.lit("")))


def get_bit(bits: Column, n: int) -> Column:
    """Bit n from the left, from 0; out of range is an error."""
    return F.when((F.lit(n) < 0) | (F.lit(n) >= F.length(bits)), F.raise_error(F.lit(f"bit index {n} out of valid range"))).otherwise(F.substring(bits, n + 1, 1).cast("int"))


def set_bit(bits: Column, n: int, to: int) -> Column:
    if to not in (0, 1):
        raise ValueError("new bit must be 0 or 1")
    return F.when((F.lit(n) < 0) | (F.lit(n) >= F.length(bits)), F.raise_error(F.lit(f"bit index {n} out of valid range"))).otherwise(F.overlay(bits, F.lit(str(to)), n + 1, 1))


def bit_and(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"))


def bit_or(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0"))


def _bitwise(a: Column, b: Column, f) -> Column:
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("cannot combine bit strings of different sizes"))).otherwise(F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), f), ""))


# Session and miscellany --------------------------------------------------------------------------------------------------
def size_pretty(n: Column) -> Column:
    """bytes, kB, MB, GB, TB: the largest unit with at least 10 of it, rounded."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for i, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        out = F.when(F.abs(n) >= 10 * 1024**i, F.concat(F.round(n / 1024**i).cast("long").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


#: Fixed names.
TYPE_NAMES = {"boolean": "boolean", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision", "string": "text", "binary": "bytea", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone"}


def pg_typeof(x: Column) -> Column:
    names = F.create_map(*(F.lit(y) for kv in TYPE_NAMES.items() for y in kv))
    kind = F.typeof(x)
    return F.coalesce(F.try_element_at(names, kind), F.when(kind.startswith("decimal"), "numeric"), kind)
