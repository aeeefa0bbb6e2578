"""Append-only ingestion of attempt logs, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def attempts(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of the Parquet parts that appear in a folder."""
    return spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)


def append(stream: DataFrame, out: str, checkpoint: str, every: str | None = None):
    """Write a stream as Parquet, each row once: until there is no more (every is None) or at intervals."""
    w = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def bursts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events (user_id, ts): start, end and number. An extension: the data model itself has no event time."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    s = x.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def status_windows(pages: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of statuses in windows of fetch time."""
    t = pages.withColumn("at", F.to_timestamp("fetched_at"))
    x = t.withWatermark("at", late) if pages.isStreaming else t
    return x.groupBy(F.window("at", width).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")
