"""Streaming slice: windowed counts with late data, resumable loads, rollover by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_folder(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A watermark on a stream; zone-less times are read as UTC, which a watermark needs."""
    if not events.isStreaming:
        return events
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count and mean value of each key in tumbling windows; rows later than the watermark are dropped. Batch frames work as well."""
    e = _timed(events, ts, late)
    return e.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "mean_value"
    )


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = _timed(events, ts, late)
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n"
    )


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append"):
    """Everything that has arrived since the last run, batch by batch through ``write``; the checkpoint is the record of what is done."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return q
