"""Aggregate functions by name; each builder takes columns and returns an aggregate column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.registry import Arg, UnknownFunction, constant

Builder = Callable[..., Column]


def _count(*a: Arg) -> Column:
    return F.count(a[0].column) if a else F.count(F.lit(1))


def _percentile(x: Arg, p: Arg) -> Column:
    return F.percentile(x.column, float(constant(p, "the percentage")) / 100)


def _percentile_approx(x: Arg, p: Arg, accuracy: Arg | None = None) -> Column:
    return F.percentile_approx(x.column, float(constant(p, "the percentage")) / 100, 10_000 if accuracy is None else int(constant(accuracy, "the accuracy")))


def _take(x: Arg, n: Arg | None = None) -> Column:
    return F.slice(F.collect_list(x.column), 1, 10 if n is None else int(constant(n, "the count")))


AGGREGATES: dict[str, Builder] = {
    "count": _count,
    "c": _count,
    "sum": lambda x: F.sum(x.column),
    "sum0": lambda x: F.coalesce(F.sum(x.column), F.lit(0)),
    "avg": lambda x: F.avg(x.column),
    "mean": lambda x: F.avg(x.column),
    "min": lambda x: F.min(x.column),
    "max": lambda x: F.max(x.column),
    "dc": lambda x: F.count_distinct(x.column),
    "distinct_count": lambda x: F.count_distinct(x.column),
    "distinct_count_approx": lambda x: F.approx_count_distinct(x.column),
    "stddev": lambda x: F.stddev_samp(x.column),
    "stddev_samp": lambda x: F.stddev_samp(x.column),
    "stddev_pop": lambda x: F.stddev_pop(x.column),
    "variance": lambda x: F.var_samp(x.column),
    "var_samp": lambda x: F.var_samp(x.column),
    "var_pop": lambda x: F.var_pop(x.column),
    "percentile": _percentile,
    "percentile_approx": _percentile_approx,
    "median": lambda x: F.median(x.column),
    "earliest": lambda x, t: F.min_by(x.column, t.column),
    "latest": lambda x, t: F.max_by(x.column, t.column),
    "min_by": lambda x, t: F.min_by(x.column, t.column),
    "max_by": lambda x, t: F.max_by(x.column, t.column),
    "first": lambda x: F.first(x.column, ignorenulls=True),
    "last": lambda x: F.last(x.column, ignorenulls=True),
    "take": _take,
    "list": lambda x: F.collect_list(x.column.cast("string")),
    "values": lambda x: F.sort_array(F.collect_set(x.column.cast("string"))),
}
_DISTINCT: dict[str, Builder] = {"count": lambda x: F.count_distinct(x.column), "sum": lambda x: F.sum_distinct(x.column)}

#: Functions that only stand before OVER.
WINDOW_ONLY: dict[str, Builder] = {
    "row_number": lambda: F.row_number(),
    "rank": lambda: F.rank(),
    "dense_rank": lambda: F.dense_rank(),
    "percent_rank": lambda: F.percent_rank(),
    "cume_dist": lambda: F.cume_dist(),
    "ntile": lambda n: F.ntile(int(constant(n, "the buckets"))),
    "lag": lambda x, n=None: F.lag(x.column, 1 if n is None else int(constant(n, "the offset"))),
    "lead": lambda x, n=None: F.lead(x.column, 1 if n is None else int(constant(n, "the offset"))),
    "first_value": lambda x: F.first(x.column),
    "last_value": lambda x: F.last(x.column),
    "nth_value": lambda x, n: F.nth_value(x.column, int(constant(n, "the position"))),
}


def aggregate(name: str, args: list[Arg], distinct: bool = False) -> Column:
    table = _DISTINCT if distinct and name in _DISTINCT else AGGREGATES
    if name not in table:
        raise UnknownFunction(f"no aggregate function named {name!r}")
    return table[name](*args)


def windowed(name: str, args: list[Arg], distinct: bool = False) -> Column:
    """An aggregate for use over a window, where counts of distinct values need another form."""
    if name in WINDOW_ONLY:
        return WINDOW_ONLY[name](*args)
    if name in ("dc", "distinct_count") or distinct and name == "count":
        return F.collect_set(args[0].column)
    return aggregate(name, args, distinct)
