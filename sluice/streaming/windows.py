"""Tumbling buckets over streams: late rows up to a watermark, one result for each bucket and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, late: str) -> tuple[DataFrame, Column]:
    """The stream with its watermark, and the bucket's start. Rows without a time are in no bucket."""
    if dict(df.dtypes)[time] == "timestamp_ntz":  # watermarks want an instant
        df = df.withColumn(time, F.col(time).cast("timestamp_ltz"))
    return df.withWatermark(time, late), F.window(F.col(time), width)


def stream_stats(df: DataFrame, time: str, width: str, late: str, keys: Sequence[str], aggregates: dict[str, Column], name: str = "bucket") -> DataFrame:
    """Aggregates by bucket of ``width`` and keys; state older than ``late`` is dropped."""
    marked, bucket = tumbling(df, time, width, late)
    out = marked.groupBy(bucket.alias("__w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("__w.start").alias(name), *keys, *aggregates)
