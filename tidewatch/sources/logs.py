"""Log text: new parts by cursor, chunk files, and status feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import LOG_CHUNKS, STATUS_SNAPSHOTS


def log_increments(logs: DataFrame, cursors: DataFrame) -> DataFrame:
    """New text per job from ``logs(job_id, text)`` and ``cursors(job_id, log_cursor)``, with the next cursor.

    Cursors count bytes of UTF-8, as offsets into files do; a character cut by one reads as the replacement character. A log
    shorter than its cursor gives no text and leaves the cursor where it is.
    """
    at = F.greatest(F.coalesce(F.col("log_cursor").cast("long"), F.lit(0)), F.lit(0))
    length = F.octet_length("text").cast("long")
    rest = F.substring(F.encode("text", "UTF-8"), F.when(at < length, at).otherwise(length).cast("int") + 1, length.cast("int"))
    return (
        logs.select("job_id", "text")
        .join(cursors.select("job_id", "log_cursor"), "job_id", "left")
        .select(
            "job_id",
            F.make_valid_utf8(rest.cast("string")).alias("new_text"),
            F.greatest(length, at).alias("log_cursor"),
        )
    )


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole log files with their path; undecodable bytes are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("ts"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_CHUNKS).parquet(path)


# One micro-batch takes this many bytes unless the caller says otherwise, so a job's share of it fits a task.
MICRO_BATCH = str(512 * 1024 * 1024)


def bounded(options: dict[str, str]) -> dict[str, str]:
    """Source options with a limit on the size of a micro-batch."""
    limits = {"maxfilespertrigger", "maxbytespertrigger"}
    return options if limits & {name.lower() for name in options} else {**options, "maxBytesPerTrigger": MICRO_BATCH}


def stream_chunks(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.readStream.schema(LOG_CHUNKS).options(**bounded(options)).parquet(path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATUS_SNAPSHOTS).parquet(path)


def stream_status(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.readStream.schema(STATUS_SNAPSHOTS).options(**bounded(options)).parquet(path)
