"""Comparison, logic and conditional functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.registry import Arg, scalar

for _name, _f in {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "<=>": lambda a, b: a.eqNullSafe(b), "and": lambda a, b: a & b, "or": lambda a, b: a | b,
}.items():
    scalar(_name, least=2, most=2)(lambda a, b, f=_f: f(a.column, b.column))


@scalar("not")
def not_(a: Arg) -> Column:
    return ~a.column


@scalar("xor")
def xor(a: Arg, b: Arg) -> Column:
    return a.column != b.column


@scalar("in", least=2)
def in_(a: Arg, *items: Arg) -> Column:
    return a.column.isin(*[i.column for i in items])


@scalar("between")
def between(a: Arg, low: Arg, high: Arg) -> Column:
    return a.column.between(low.column, high.column)


@scalar("isnull")
def isnull(a: Arg) -> Column:
    return a.column.isNull()


@scalar("isnotnull", "ispresent")
def isnotnull(a: Arg) -> Column:
    return a.column.isNotNull()


@scalar("if", "iff")
def if_(cond: Arg, yes: Arg, no: Arg) -> Column:
    return F.when(cond.column, yes.column).otherwise(no.column)


@scalar("coalesce", least=1)
def coalesce(*args: Arg) -> Column:
    return F.coalesce(*[a.column for a in args])


@scalar("ifnull", "nvl")
def ifnull(a: Arg, b: Arg) -> Column:
    return F.coalesce(a.column, b.column)


@scalar("nullif")
def nullif(a: Arg, b: Arg) -> Column:
    return F.nullif(a.column, b.column)


@scalar("isempty")
def isempty(a: Arg) -> Column:
    return a.column.isNull() | (F.length(a.column) == 0)


@scalar("isblank")
def isblank(a: Arg) -> Column:
    return a.column.isNull() | (F.length(F.trim(a.column)) == 0)


@scalar("greatest", least=2)
def greatest(*args: Arg) -> Column:
    return F.greatest(*[a.column for a in args])


@scalar("least", least=2)
def least_(*args: Arg) -> Column:
    return F.least(*[a.column for a in args])
