"""Where results go: message tables and request tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message_rows(results: DataFrame) -> DataFrame:
    """Messages of log actions: time, job, level and text."""
    return results.filter(F.col("action") == "LogAction").select("ts", "job_id", "level", "message")


def write_messages(results: DataFrame, path: str) -> None:
    """Append messages, laid out by level."""
    message_rows(results).write.mode("append").partitionBy("level").parquet(path)


def write_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "60 seconds"):
    """Start a stream into parquet: drain what is there, or poll at an interval."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
