"""Event-time windows over streams (and, unchanged, over tables): tumbling, sliding, session, and deduplication.

The same function takes a batch table or a stream; only a stream gets a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    if not events.isStreaming:
        return events.withColumn("at", F.col("ts"))  # windows of a wall clock stay on it, whatever the session's zone
    x = events.withColumn("at", F.col("ts").cast("timestamp"))
    return x.withWatermark("at", late) if late else x


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Count and sum of value by event_type in windows of a width."""
    g = _timed(events, late).groupBy(F.window("at", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "1 hour") -> DataFrame:
    g = _timed(events, late).groupBy(F.window("at", width, step).alias("w"))
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after a gap."""
    g = _timed(events, late).groupBy(F.session_window("at", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n"), F.max("at").cast("timestamp_ntz").alias("last")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "last", "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    x = _timed(events, late)
    return x.dropDuplicatesWithinWatermark(keys) if events.isStreaming else x.dropDuplicates(keys)


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there now, exactly once, into Parquet files."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
