"""Scan events as a stream: counters per wave, activity windows, and the latest state of each key.

The same functions take a batch or a stream; ``run_available`` reads what a folder
has, keeps its state in the checkpoint, and goes on from there when run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counters(events: DataFrame) -> DataFrame:
    """Events of each type and user group, with the share of errors."""
    grouped = events.groupBy((F.col("user_id") % 10).alias("wave")).agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_if(F.col("event_type") == "purchase").alias("n_flagged"), F.round(F.sum("value"), 4).alias("total_value"))
    return grouped.withColumn("error_rate", F.round(F.try_divide("n_errors", "n_events"), 6))


def activity(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; on a stream, windows close ``late`` after their end."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n_events"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n_events")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with at most ``gap`` between them."""
    timed = events.withWatermark("ts", "10 minutes") if events.isStreaming else events
    counted = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), "n_events")


def run_available(spark: SparkSession, source: str, schema, transform, sink: str, checkpoint: str, mode: str = "append", most_files: int = 100) -> None:
    """Process what is new in the folder ``source`` and append ``transform`` of it to ``sink``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
