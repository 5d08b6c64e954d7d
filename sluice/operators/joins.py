"""Joins: kinds, residual conditions, name clashes, and strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti", "cross")
HINTS = {"broadcast": "broadcast", "shuffle_hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl"}


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's own estimate of a plan's output."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a side's estimate is within ``limit`` bytes, by default the session's broadcast threshold."""
    if limit is None:
        spark: SparkSession = df.sparkSession
        limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return size_in_bytes(df) <= limit


def join(left: DataFrame, right: DataFrame, condition: Column | None, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Join on any condition: equalities become keys, the rest is judged within the join.

    Without a hint the planner and adaptive execution choose by size and split
    skewed keys. A broadcast hint is taken only for a side of a checked size.
    """
    if how not in KINDS:
        raise ValueError(f"no join of kind {how!r}")
    if hint is not None:
        if hint not in HINTS:
            raise ValueError(f"no join strategy named {hint!r}")
        if hint != "broadcast":
            right = right.hint(HINTS[hint])
        elif small(right):
            right = F.broadcast(right)
    if condition is None:
        return left.crossJoin(right) if how == "cross" else left.join(right, F.lit(True), how)
    return left.join(right, condition, "inner" if how == "cross" else how)


def colocated(spark: SparkSession, left: str, right: str, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that are bucketed alike by ``keys``: no exchange on either side."""
    return spark.table(left).join(spark.table(right), keys, how)
