"""Marker files as a table of path, content and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markers(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """Files below ``path``. Without content only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = F.regexp_replace("path", "^file:/*", "/")
    columns = [plain.alias("path"), F.col("modificationTime").cast("timestamp_ntz").alias("ts")]
    if with_content:
        columns.append(F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return files.select(*columns)
