"""Windowed counts over events, batch or stream: the same transformation serves both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tumbling_counts(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, value) by tumbling windows; ``late`` is the watermark of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def start_counts(spark: SparkSession, path: str, schema: StructType, out: str, checkpoint: str, size: str = "1 hour", late: str = "2 hours"):
    """Stream of Parquet files to windowed counts as Parquet; exactly once by its checkpoint."""
    stream = tumbling_counts(spark.readStream.schema(schema).parquet(path), size, late)
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
