from __future__ import annotations

from pyspark.sql import functions as F

from sluice.streaming import stream_stats


def test_stream_equals_batch(spark, sf, tmp_path):  # noqa: ANN001
    batch = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type", "value")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    out = stream_stats(stream, "ts", "1 day", "365 days", ["event_type"], {"n": F.count("*"), "s": F.round(F.sum("value"), 4)})
    q = out.writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = batch.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp_ltz")).alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"))
    assert sorted(map(tuple, spark.table("buckets").collect())) == sorted(map(tuple, want.collect()))
