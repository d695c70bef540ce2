"""Dates, times and intervals. An interval is a struct (months, days, micros), as Spark's own interval types can't mix them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def interval(months: Column | int = 0, days: Column | int = 0, us: Column | int = 0) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(months).cast("int").alias("months"), as_col(days).cast("int").alias("days"), as_col(us).cast("long").alias("micros"))


#: Units of interval text, as (months, days, microseconds).
UNITS = {
    "year": (12, 0, 0), "month": (1, 0, 0), "week": (0, 7, 0), "day": (0, 1, 0),
    "hour": (0, 0, 3_600_000_000), "minute": (0, 0, 60_000_000), "second": (0, 0, 1_000_000), "millisecond": (0, 0, 1_000), "microsecond": (0, 0, 1),
}
SHORT = {"y": "year", "mon": "month", "w": "week", "d": "day", "h": "hour", "hr": "hour", "min": "minute", "m": "minute", "s": "second", "sec": "second", "ms": "millisecond", "us": "microsecond"}


def parse_interval(text: str) -> tuple[int, int, int]:
    """(months, days, microseconds) of interval text such as '1 year 2 days 03:04:05.6 ago'."""
    months = days = 0
    us = 0.0
    body = text.strip().lower()
    sign = -1 if body.endswith("ago") else 1
    body = body.removesuffix("ago")
    for clock in re.findall(r"[-+]?\d+:\d+(?::\d+(?:\.\d+)?)?", body):
        parts = clock.lstrip("+-").split(":")
        value = int(parts[0]) * 3_600_000_000 + int(parts[1]) * 60_000_000 + (round(float(parts[2]) * 1_000_000) if len(parts) > 2 else 0)
        us += -value if clock[0] == "-" else value
        body = body.replace(clock, " ", 1)
    rest = re.sub(r"[-+]?\d+(?:\.\d+)?\s*[a-z]+|\s|@|,", "", body)
    if rest:
        raise ValueError(f"invalid interval: {text!r}")
    for number, unit in re.findall(r"([-+]?\d+(?:\.\d+)?)\s*([a-z]+)", body):
        unit = SHORT.get(unit) or SHORT.get(unit.rstrip("s")) or unit.rstrip("s")
        if unit not in UNITS:
            raise ValueError(f"invalid interval unit: {unit!r}")
        m, d, u = UNITS[unit]
        x = float(number)
        whole = x * m
        months += int(whole)
        day = (whole - int(whole)) * 30 + x * d
        days += int(day)
        us += (day - int(day)) * DAY + x * u
    return sign * months, sign * days, sign * round(us)


def interval_literal(text: str) -> Column:
    return interval(*parse_interval(text))


def interval_text(i: Column) -> Column:
    """As PostgreSQL prints it."""
    m, d, u = i["months"], i["days"], i["micros"]
    plural = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s")))
    toward = lambda a, b: F.when(a < 0, -F.floor(-a / b)).otherwise(F.floor(a / b)).cast("long")
    years, months = plural(toward(m, 12), "year"), plural(m - toward(m, 12) * 12, "mon")
    x = F.abs(u)
    fraction = F.regexp_replace(F.format_string(".%06d", x % 1_000_000), r"\.?0+$", "")
    clock = F.concat(F.when(u < 0, "-").otherwise(""), F.format_string("%02d:%02d:%02d", F.floor(x / 3_600_000_000), F.floor(x / 60_000_000) % 60, F.floor(x / 1_000_000) % 60), fraction)
    clock = F.when((u != 0) | ((m == 0) & (d == 0)), clock)
    return F.concat_ws(" ", years, months, plural(d, "day"), clock)


def add_interval(ts: Column, i: Column) -> Column:
    """Months first (days are clipped to the month's last), then days, then time."""
    moved = ts.cast("timestamp") + F.make_ym_interval(F.lit(0), i["months"])
    return F.timestamp_micros(F.unix_micros(moved) + i["days"].cast("long") * DAY + i["micros"])


def subtract(a: Column, b: Column) -> Column:
    """Days and microseconds between two timestamps."""
    gap = micros(a) - micros(b)
    days = F.when(gap < 0, -F.floor(-gap / DAY)).otherwise(F.floor(gap / DAY)).cast("long")
    return interval(0, days, gap - days * DAY)


def age(a: Column, b: Column) -> Column:
    """Field by field, borrowing days from the month of the earlier end; negative if a is before b."""
    hi, lo = F.greatest(a.cast("timestamp"), b.cast("timestamp")), F.least(a.cast("timestamp"), b.cast("timestamp"))
    time = lambda t: F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t))
    us = time(hi) - time(lo)
    borrow = (us < 0).cast("int")
    days = F.dayofmonth(hi) - F.dayofmonth(lo) - borrow
    us = us + borrow * DAY
    short = (days < 0).cast("int")
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo) - short
    days = days + short * F.dayofmonth(F.last_day(lo))
    sign = F.when(a.cast("timestamp") < b.cast("timestamp"), -1).otherwise(1)
    return interval(months * sign, days * sign, us * sign)


def date_diff_days(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def date_bin(stride: str, ts: Column, origin: Column) -> Column:
    """The start of ts's bin, bins being counted from the origin. Strides of months are refused."""
    months, days, us = parse_interval(stride)
    step = days * DAY + us
    if months or step <= 0:
        raise ValueError("a stride is a positive number of days and less")
    start = micros(origin)
    return F.timestamp_micros(start + (micros(ts) - start) - F.pmod(micros(ts) - start, F.lit(step)))


def extract(field: str, ts: Column) -> Column:
    """A decimal. Seconds and smaller have their fractions."""
    t = ts.cast("timestamp")
    of_minute = F.pmod(F.unix_micros(t), F.lit(60_000_000))
    parts = {
        "year": lambda: F.year(t), "quarter": lambda: F.quarter(t), "month": lambda: F.month(t), "day": lambda: F.dayofmonth(t), "hour": lambda: F.hour(t), "minute": lambda: F.minute(t),
        "second": lambda: of_minute.cast("decimal(20,6)") / 1_000_000, "milliseconds": lambda: of_minute.cast("decimal(20,3)") / 1_000, "microseconds": lambda: of_minute, "epoch": lambda: F.unix_micros(t).cast("decimal(26,6)") / 1_000_000,
    }
    return parts[field]().cast("decimal(26,6)")


def at_time_zone(ts: Column, zone: str) -> Column:
    """The wall clock of an instant in a zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def from_time_zone(ts: Column, zone: str) -> Column:
    """The instant of a wall clock in a zone."""
    return F.to_utc_timestamp(ts.cast("timestamp"), zone)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open periods, whose ends may be given in either order; an empty period is an instant."""
    a, b, c, d = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    return ((a < d) & (c < b)) | (a == c)
