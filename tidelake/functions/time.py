"""Time buckets, boundaries and epochs as plain column expressions."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["bucket_width", "date_diff", "dow", "epoch", "epoch_to_micros", "mqtt_epoch_to_micros", "time_bucket"]

#: Buckets of fixed width begin at a Monday, buckets of months at a January.
ORIGIN, MONTH_ORIGIN = "2000-01-03 00:00:00", "2000-01-01 00:00:00"
MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def bucket_width(width: str) -> tuple[int, int]:
    """(microseconds, months) of a width like '5 minutes' or '3 months'; one of the two is 0."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", width.lower())
    if not m or not int(m[1]) or m[2] not in MICROS | MONTHS:
        raise ValueError(f"no bucket width: {width!r}")
    return (int(m[1]) * MICROS[m[2]], 0) if m[2] in MICROS else (0, int(m[1]) * MONTHS[m[2]])


def at(moment: str | datetime) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def time_bucket(width: str, ts: Column | str, origin: str | datetime | None = None) -> Column:
    """The start of ts's bucket; buckets of `width` are counted from the origin in both directions. Null: null."""
    ts = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    micros, months = bucket_width(width)
    if micros:
        start = at(origin or ORIGIN)
        past = F.timestamp_diff("MICROSECOND", start, ts)
        return F.timestamp_add("MICROSECOND", past - F.pmod(past, F.lit(micros)), start)
    start = at(origin or MONTH_ORIGIN)
    past = (F.year(ts) - F.year(start)) * 12 + F.month(ts) - F.month(start)
    past = past - F.when(F.timestamp_add("MONTH", past, start) > ts, 1).otherwise(0)
    return F.timestamp_add("MONTH", past - F.pmod(past, F.lit(months)), start)


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """How many boundaries of unit lie between two times (not whole units: 00:59 to 01:01 is one hour)."""
    a, b = (F.date_trunc(unit, x.cast("timestamp_ntz")).cast("timestamp_ntz") for x in (start, end))
    return F.timestamp_diff(unit.upper(), a, b)


def dow(ts: Column) -> Column:
    """Day of the week, Sunday 0."""
    return F.dayofweek(ts) - 1


def epoch(ts: Column) -> Column:
    """Seconds since 1970 with fraction, of a time without zone."""
    return F.timestamp_diff("MICROSECOND", at("1970-01-01"), ts) / F.lit(1e6)


def by_size(t: Column, limits: list[tuple[float, Column]], otherwise: Column) -> Column:
    out = otherwise
    for limit, value in reversed(limits):
        out = F.when(F.abs(t) < F.lit(limit), value).otherwise(out)
    return out


def epoch_to_micros(t: Column) -> Column:
    """Microseconds of an epoch whose unit its size tells: below 1e10 s, 1e13 ms, 1e16 us, else ns."""
    t = t.cast("long")
    return by_size(t, [(1e10, t * 1_000_000), (1e13, t * 1_000), (1e16, t)], nanos(t))


def nanos(t: Column) -> Column:
    """Microseconds of nanoseconds, towards zero."""
    return ((t - t % F.lit(1000)).cast("decimal(20,0)") / F.lit(1000)).cast("long")


def mqtt_epoch_to_micros(t: Column) -> Column:
    """The message source's own limits: above 1e18 ns, above 1e15 us, above 1e12 ms, else s."""
    t = t.cast("long")
    return F.when(t > F.lit(10**18), nanos(t)).when(t > F.lit(10**15), t).when(t > F.lit(10**12), t * 1_000).otherwise(t * 1_000_000)
