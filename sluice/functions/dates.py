"""Date and time functions. Timestamps have no zone; times of day are milliseconds as a long."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import Arg, constant, scalar

NTZ = "timestamp_ntz"


def moment(c: Column) -> Column:
    """As a timestamp without zone."""
    return c.cast(NTZ)


for _names, _f in {
    ("year",): F.year, ("month", "month_of_year"): F.month, ("day", "day_of_month", "dayofmonth"): F.dayofmonth, ("hour", "hour_of_day"): F.hour, ("minute", "minute_of_hour"): F.minute, ("second", "second_of_minute"): F.second, ("quarter",): F.quarter,
    ("week", "week_of_year", "weekofyear"): F.weekofyear, ("day_of_week", "dayofweek"): F.dayofweek, ("day_of_year", "dayofyear"): F.dayofyear, ("weekday",): F.weekday, ("last_day",): F.last_day,
    ("dayname",): lambda c: F.date_format(c, "EEEE"), ("monthname",): lambda c: F.date_format(c, "MMMM"), ("to_days",): lambda c: F.datediff(c, F.lit("0000-01-01").cast("date")) + 0,
    ("to_seconds",): lambda c: F.datediff(c, F.lit("0000-01-01").cast("date")).cast("bigint") * 86400 + F.hour(moment(c)) * 3600 + F.minute(moment(c)) * 60 + F.second(moment(c)),
    ("from_days",): lambda c: F.date_add(F.lit("0000-01-01").cast("date"), c), ("sec_to_time",): lambda c: F.date_format(F.timestamp_seconds(c), "HH:mm:ss"),
    ("minute_of_day",): lambda c: F.hour(c) * 60 + F.minute(c), ("yearweek",): lambda c: F.extract(F.lit("YEAROFWEEK"), c) * 100 + F.weekofyear(c),
}.items():
    scalar(*_names, least=1, most=1)(lambda a, f=_f: f(a.column))

scalar("now", "current_timestamp", "localtimestamp", "sysdate", "utc_timestamp", least=0, most=1)(lambda *_: F.localtimestamp())
scalar("current_date", "curdate", "utc_date", least=0, most=0)(lambda: F.current_date())
scalar("current_time", "curtime", "utc_time", least=0, most=0)(lambda: millis_of_day(F.localtimestamp()))


def millis_of_day(c: Column) -> Column:
    t = moment(c)
    return (F.hour(t) * 3_600_000 + F.minute(t) * 60_000).cast("bigint") + F.floor(F.extract(F.lit("SECOND"), t) * 1000).cast("bigint")


_UNITS = {"microsecond": "MICROSECOND", "second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY", "week": "WEEK", "month": "MONTH", "quarter": "QUARTER", "year": "YEAR"}


def shifted(c: Column, n: Column, unit: str) -> Column:
    """``c`` moved by ``n`` units, as a timestamp."""
    t = moment(c)
    u = unit.lower()
    if u not in _UNITS:
        raise ValueError(f"no time unit named {unit!r}")
    if u in ("month", "quarter", "year"):
        months = n * {"month": 1, "quarter": 3, "year": 12}[u]
        return t + F.make_ym_interval(F.lit(0), months.cast("int"))
    days, hours, minutes, seconds = F.lit(0), F.lit(0), F.lit(0), F.lit(0)
    if u in ("day", "week"):
        days = (n * (7 if u == "week" else 1)).cast("int")
    elif u == "hour":
        hours = n.cast("int")
    elif u == "minute":
        minutes = n.cast("int")
    else:
        seconds = (n / (1_000_000 if u == "microsecond" else 1)).cast("decimal(18,6)")
    return t + F.make_dt_interval(days, hours, minutes, seconds)


@scalar("date_add", "adddate")
def date_add(d: Arg, n: Arg) -> Column:
    """Days later: of a date a date, of a timestamp a timestamp."""
    return F.date_add(d.column, n.column) if isinstance(d.kind(), T.DateType) else shifted(d.column, n.column, "day")


@scalar("date_sub", "subdate")
def date_sub(d: Arg, n: Arg) -> Column:
    return F.date_sub(d.column, n.column) if isinstance(d.kind(), T.DateType) else shifted(d.column, -n.column, "day")


@scalar("timestampadd")
def timestampadd(unit: Arg, n: Arg, t: Arg) -> Column:
    return shifted(t.column, n.column, constant(unit, "the unit"))


@scalar("timestampdiff")
def timestampdiff(unit: Arg, a: Arg, b: Arg) -> Column:
    return F.timestamp_diff(constant(unit, "the unit").upper(), moment(a.column), moment(b.column))


@scalar("datediff")
def datediff(a: Arg, b: Arg) -> Column:
    return F.datediff(a.column.cast("date"), b.column.cast("date"))


def clock(a: Arg) -> Column:
    """A timestamp from one, or from text with or without a date."""
    if isinstance(a.kind(), T.StringType):
        return moment(F.when(a.column.contains("-"), a.column).otherwise(F.concat(F.lit("1970-01-01 "), a.column)))
    return moment(a.column)


@scalar("timediff")
def timediff(a: Arg, b: Arg) -> Column:
    return millis_of_day(clock(a)) - millis_of_day(clock(b))


@scalar("addtime")
def addtime(t: Arg, d: Arg) -> Column:
    return shifted(clock(t), millis_of_day(clock(d)) / 1000, "second")


@scalar("subtime")
def subtime(t: Arg, d: Arg) -> Column:
    return shifted(clock(t), -millis_of_day(clock(d)) / 1000, "second")


_FORMAT = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h", "%i": "mm", "%M": "MMMM", "%b": "MMM", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%T": "HH:mm:ss", "%r": "hh:mm:ss a"}


def pattern(fmt: str) -> str:
    """A percent pattern as the engine's own; other text is quoted."""
    out = ""
    for part in re.findall(r"%.|[^%]+", fmt):
        if part.startswith("%") and len(part) == 2:
            out += _FORMAT.get(part, "''" if part == "%'" else "'" + part[1] + "'")
        elif re.search("[A-Za-z]", part):
            out += part if "%" not in fmt else "'" + part.replace("'", "''") + "'"
        else:
            out += part
    return out


@scalar("date_format", "time_format", "strftime")
def date_format(t: Arg, fmt: Arg) -> Column:
    return F.date_format(clock(t), pattern(constant(fmt, "the format")))


@scalar("str_to_date")
def str_to_date(text: Arg, fmt: Arg) -> Column:
    """Where codes do not touch, numbers may have one digit or two."""
    code = constant(fmt, "the format")
    form = pattern(code)
    if not re.search(r"%\w%\w", code):
        form = re.sub(r"(?<![A-Za-z])(dd|MM|HH|hh|mm|ss)(?![A-Za-z])", lambda m: m[0][0], form)
    return moment(F.to_timestamp(text.column, form))


@scalar("get_format")
def get_format(kind: Arg, region: Arg) -> Column:
    table = {"date": {"USA": "%m.%d.%Y", "JIS": "%Y-%m-%d", "ISO": "%Y-%m-%d", "EUR": "%d.%m.%Y", "INTERNAL": "%Y%m%d"}, "time": {"USA": "%h:%i:%s %p", "JIS": "%H:%i:%s", "ISO": "%H:%i:%s", "EUR": "%H.%i.%s", "INTERNAL": "%H%i%s"}}
    table["datetime"] = table["timestamp"] = {"USA": "%Y-%m-%d %H.%i.%s", "JIS": "%Y-%m-%d %H:%i:%s", "ISO": "%Y-%m-%d %H:%i:%s", "EUR": "%Y-%m-%d %H.%i.%s", "INTERNAL": "%Y%m%d%H%i%s"}
    return F.lit(table[constant(kind, "the kind").lower()][constant(region, "the region").upper()])


@scalar("date_trunc")
def date_trunc(unit: Arg, t: Arg) -> Column:
    return moment(F.date_trunc(constant(unit, "the unit"), moment(t.column)))


@scalar("from_unixtime")
def from_unixtime(n: Arg, fmt: Arg | None = None) -> Column:
    t = moment(F.timestamp_seconds(n.column))
    return t if fmt is None else F.date_format(t, pattern(constant(fmt, "the format")))


@scalar("unix_timestamp", least=0, most=1)
def unix_timestamp(*t: Arg) -> Column:
    return F.unix_timestamp(moment(t[0].column).cast("timestamp")) if t else F.unix_timestamp()


_EXTRACT = {"day_of_month": "DAY", "day_of_week": "DAYOFWEEK", "dow": "DAYOFWEEK", "day_of_year": "DOY", "doy": "DOY", "week_of_year": "WEEK"}


@scalar("extract")
def extract(unit: Arg, t: Arg) -> Column:
    u = constant(unit, "the unit").lower()
    if u in ("epoch", "decade", "century", "millennium"):
        raise ValueError(f"extract does not know {u!r}")
    return F.floor(F.extract(F.lit(_EXTRACT.get(u, u.upper())), t.column)).cast("bigint")


@scalar("timestamp")
def timestamp(t: Arg) -> Column:
    """A timestamp from ISO text, with or without a zone, or from a date."""
    if isinstance(t.kind(), T.StringType):
        zoned = r"T.*(Z|[+-]\d\d:?\d\d)$"
        if t.is_literal:
            return moment(F.to_timestamp_ltz(t.column)) if re.search(zoned, t.literal) else F.to_timestamp_ntz(t.column)
        return F.when(t.column.rlike(zoned), moment(F.to_timestamp_ltz(t.column))).otherwise(F.to_timestamp_ntz(t.column))
    return moment(t.column)


@scalar("date")
def date(t: Arg) -> Column:
    return t.column.cast(NTZ).cast("date") if isinstance(t.kind(), T.StringType) else t.column.cast("date")


@scalar("time", "time_of_day")
def time(t: Arg) -> Column:
    """Milliseconds of the day, from a timestamp or from text with or without a date."""
    return millis_of_day(clock(t))


@scalar("time_to_sec")
def time_to_sec(t: Arg) -> Column:
    return F.floor(time(t) / 1000).cast("bigint")


@scalar("makedate")
def makedate(year: Arg, day: Arg) -> Column:
    return F.date_add(F.make_date(year.column, F.lit(1), F.lit(1)), day.column - 1)


@scalar("maketime")
def maketime(h: Arg, m: Arg, s: Arg) -> Column:
    return ((h.column * 3600 + m.column * 60 + s.column) * 1000).cast("bigint")


def _months(p: Column) -> Column:
    """Months since year 0 of a period YYYYMM or YYMM."""
    year = F.floor(p / 100)
    full = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return full * 12 + p % 100 - 1


@scalar("period_add")
def period_add(p: Arg, n: Arg) -> Column:
    m = _months(p.column) + n.column
    return (F.floor(m / 12) * 100 + m % 12 + 1).cast("int")


@scalar("period_diff")
def period_diff(a: Arg, b: Arg) -> Column:
    return (_months(a.column) - _months(b.column)).cast("int")


@scalar("convert_tz")
def convert_tz(t: Arg, source: Arg, target: Arg) -> Column:
    return F.convert_timezone(source.column, target.column, moment(t.column))


_RELATIVE = {"s": "second", "sec": "second", "m": "minute", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "day": "day", "w": "week", "week": "week", "mon": "month", "month": "month", "q": "quarter", "y": "year", "year": "year"}


def relative(text: str) -> Column:
    """A time from text: absolute, ``now``, or steps from now such as ``-1d+2h@d``, where @ goes back to a unit's start."""
    if re.match(r"\d{4}-", text):
        return moment(F.lit(text))
    steps = re.findall(r"([+-])(\d*)([a-z]+)|@([a-z]+)", text.lower().removeprefix("now").removeprefix("()"))
    if "".join(f"{a}{n}{u}" if u else f"@{at}" for a, n, u, at in steps) != text.lower().removeprefix("now").removeprefix("()") or any((u or at) not in _RELATIVE for _, _, u, at in steps):
        raise ValueError(f"no time: {text!r}")
    out = F.localtimestamp()
    for sign, n, unit, at in steps:
        out = moment(F.date_trunc(_RELATIVE[at], out)) if at else shifted(out, F.lit(int(n or 1) * (-1 if sign == "-" else 1)), _RELATIVE[unit])
    return out


@scalar("earliest")
def earliest(text: Arg, field: Arg) -> Column:
    """As a condition: the field is at that time or later."""
    return moment(field.column) >= relative(constant(text, "the time"))


@scalar("latest")
def latest(text: Arg, field: Arg) -> Column:
    """As a condition: the field is at that time or earlier."""
    return moment(field.column) <= relative(constant(text, "the time"))
