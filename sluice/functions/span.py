"""Buckets: ``span(field, width)`` and the widths of ``bin``.

Plain arithmetic on the column, so that null values keep a bucket of their own
and no function of the window kind drops them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units as written; M is a month and m a minute.
UNITS = {"us": "microsecond", "microsecond": "microsecond", "ms": "millisecond", "millisecond": "millisecond", "s": "second", "second": "second", "seconds": "second", "m": "minute", "min": "minute", "minute": "minute", "minutes": "minute", "h": "hour", "hour": "hour", "hours": "hour", "d": "day", "day": "day", "days": "day", "w": "week", "week": "week", "weeks": "week", "M": "month", "mon": "month", "month": "month", "months": "month", "q": "quarter", "quarter": "quarter", "quarters": "quarter", "y": "year", "year": "year", "years": "year"}
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
MONDAY = "1969-12-29"


def time_bucket(c: Column, n: int, unit: str, is_date: bool) -> Column:
    """Start of the bucket of ``n`` units that holds ``c``.

    Single units start at their natural boundary, weeks on Monday. Several
    seconds to days count from 1970, weeks from the Monday before it, months to
    years from January of year 0 in whole months.
    """
    if n <= 0:
        raise ValueError("a span must be positive")
    u = UNITS.get(unit)
    if u is None:
        raise ValueError(f"no time unit named {unit!r}")
    kind = "date" if is_date else "timestamp_ntz"
    if is_date and u not in ("day", "week", *_MONTHS):
        raise ValueError(f"a date has no buckets of {u}s")
    t = c.cast("timestamp_ntz")
    if n == 1 and u not in ("millisecond", "microsecond"):
        return F.date_trunc(u, t).cast("timestamp_ntz").cast(kind)
    if u == "week":
        start = F.lit(MONDAY).cast("date")
        return F.date_add(start, (F.floor(F.datediff(c.cast("date"), start) / (7 * n)) * (7 * n)).cast("int")).cast(kind)
    if u in _MONTHS:
        m = n * _MONTHS[u]
        index = F.year(c) * 12 + F.month(c) - 1
        first = index - F.pmod(index, F.lit(m))
        return F.make_date(F.floor(first / 12).cast("int"), F.pmod(first, F.lit(12)) + 1, F.lit(1)).cast(kind)
    micros = F.unix_micros(t.cast("timestamp_ltz"))
    width = n * (1_000_000 * _SECONDS[u] if u in _SECONDS else 1_000 if u == "millisecond" else 1)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width))).cast("timestamp_ntz").cast(kind)


def number_bucket(c: Column, width: float, kind: T.DataType) -> Column:
    """Lower end of the bucket of ``width``: whole for whole numbers and widths, exact beyond 2^53."""
    if width <= 0:
        raise ValueError("a span must be positive")
    if isinstance(kind, T.IntegralType) and float(width).is_integer():
        w = F.lit(int(width)).cast(kind if int(width) < 128 else "bigint")
        return c - F.pmod(c, w)
    return F.floor(c.cast("double") / float(width)) * float(width)


def log_bucket(c: Column, base: float) -> Column:
    """Lower end of the bucket between two powers of ``base``; null up to zero."""
    exponent = F.floor(F.round(F.ln(c.cast("double")) / F.ln(F.lit(base)), 12))
    return F.when(c > 0, F.pow(F.lit(base), exponent))


def span(c: Column, width: float, unit: str | None, kind: T.DataType) -> Column:
    if unit is None:
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise ValueError("a span over time wants a unit")
        return number_bucket(c, width, kind)
    if isinstance(kind, T.NumericType):
        raise ValueError("a span with a unit wants a time field")
    if not float(width).is_integer():
        raise ValueError("a span of time wants a whole width")
    return time_bucket(c, int(width), unit, isinstance(kind, T.DateType))
