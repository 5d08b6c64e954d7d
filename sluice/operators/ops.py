"""Operators on plain DataFrames."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.sources.catalog import ref


def top_n(df: DataFrame, keys: Sequence[Column], n: int, offset: int = 0) -> DataFrame:
    """First rows of an order. Each task keeps its own first ``offset + n``; nothing is sorted as a whole."""
    df = df.orderBy(*keys)
    return (df.offset(offset) if offset else df).limit(n)


def dedup(df: DataFrame, fields: Sequence[str], order: Sequence[Column] = (), count: int = 1, keep_empty: bool = False) -> DataFrame:
    """First ``count`` rows of each combination, by ``order`` or as they come; rows with a null field go unless kept."""
    keys = [ref(f) for f in fields]
    whole = functools.reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
    order = list(order) or [F.monotonically_increasing_id()]
    full = df.where(whole)
    if count == 1 and len(order) == 1 and not fields:
        return full.limit(1)
    first = full.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(ref("__row") <= count).drop("__row")
    return first.unionByName(df.where(~whole)) if keep_empty else first


def eventstats(df: DataFrame, aggregates: dict[str, Column], keys: dict[str, Column]) -> DataFrame:
    """All rows with aggregates of their group added.

    Groups are aggregated, with partial sums in each task, and joined back, so
    that a group of any size is spread over tasks; a window would bring it into one.
    """
    named = [c.alias(n) for n, c in aggregates.items()]
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*named)))  # one row
    marks = {f"__key{i}": c for i, c in enumerate(keys.values())}
    base = df.select("*", *[c.alias(n) for n, c in marks.items()])
    groups = base.groupBy(*marks).agg(*named).withColumnsRenamed({m: m + "g" for m in marks})
    same = functools.reduce(lambda a, b: a & b, [ref(m).eqNullSafe(ref(m + "g")) for m in marks])
    return base.join(groups, same, "left").select(*[ref(c) for c in df.columns], *[ref(n) for n in aggregates])


def bin_count(df: DataFrame, field: str, bins: int, alias: str) -> DataFrame:
    """``bins`` buckets of equal width between the least and the largest value, which one row of an aggregate gives."""
    x = ref(field).cast("double")
    ends = df.agg(F.min(x).alias("__low"), F.max(x).alias("__high"))
    width = (ref("__high") - ref("__low")) / bins
    step = F.least(F.floor((x - ref("__low")) / width), F.lit(bins - 1))
    low = F.when(width == 0, ref("__low")).otherwise(ref("__low") + step * width)
    out = df.crossJoin(F.broadcast(ends))
    columns = [low.alias(alias) if c == alias else ref(c) for c in df.columns]
    return out.select(*columns, *([] if alias in df.columns else [low.alias(alias)]))


def cube(df: DataFrame, keys: Sequence[Column], aggregates: Sequence[Column], rollup: bool = False) -> DataFrame:
    return (df.rollup if rollup else df.cube)(*keys).agg(*aggregates)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[ref(k) for k in s] for s in sets], *[ref(k) for k in keys]).agg(*aggregates)


def union(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    out = a.unionByName(b, allowMissingColumns=True)
    return out.distinct() if distinct else out


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*[ref(c) for c in a.columns]))


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*[ref(c) for c in a.columns]))
