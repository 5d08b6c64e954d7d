"""Array and multi-value functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.registry import Arg, constant, scalar


@scalar("array", least=0)
def array(*args: Arg) -> Column:
    return F.array(*[a.column for a in args])


@scalar("array_length", "mvcount")
def array_length(a: Arg) -> Column:
    return F.size(a.column)


@scalar("split")
def split(a: Arg, sep: Arg) -> Column:
    import re

    return F.split(a.column, re.escape(constant(sep, "the separator")).replace("\\ ", " "))


@scalar("mvappend", least=1)
def mvappend(*args: Arg) -> Column:
    from pyspark.sql import types as T

    return F.concat(*[a.column if isinstance(a.kind(), T.ArrayType) else F.array_compact(F.array(a.column)) for a in args])


@scalar("mvdedup", "array_distinct")
def mvdedup(a: Arg) -> Column:
    return F.array_distinct(a.column)


@scalar("mvfind")
def mvfind(a: Arg, pattern: Arg) -> Column:
    """Index from 0 of the first element that matches the pattern, else null."""
    return F.nullif(F.array_position(F.transform(a.column, lambda x: x.rlike(constant(pattern, "the pattern"))), True) - 1, F.lit(-1))


@scalar("mvindex")
def mvindex(a: Arg, start: Arg, stop: Arg | None = None) -> Column:
    """Element at an index from 0, from the end if negative; with two indexes the elements between, both included."""
    if stop is None:
        return F.get(a.column, F.when(start.column < 0, F.size(a.column) + start.column).otherwise(start.column))
    n = F.size(a.column)
    lo = F.when(start.column < 0, n + start.column).otherwise(start.column)
    hi = F.when(stop.column < 0, n + stop.column).otherwise(stop.column)
    return F.slice(a.column, F.greatest(lo, F.lit(0)) + 1, F.greatest(hi - F.greatest(lo, F.lit(0)) + 1, F.lit(0)))


@scalar("mvjoin")
def mvjoin(a: Arg, sep: Arg) -> Column:
    return F.array_join(a.column, constant(sep, "the separator"))


@scalar("mvzip")
def mvzip(a: Arg, b: Arg, sep: Arg | None = None) -> Column:
    return F.zip_with(a.column, b.column, lambda x, y: F.concat_ws("," if sep is None else constant(sep, "the separator"), x.cast("string"), y.cast("string")))


@scalar("array_contains")
def array_contains(a: Arg, x: Arg) -> Column:
    return F.array_contains(a.column, x.column)


@scalar("array_sum")
def array_sum(a: Arg) -> Column:
    return F.aggregate(a.column, F.lit(0.0), lambda s, x: s + x)
