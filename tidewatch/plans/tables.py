"""The given tables in the roles the library works with, and the registry of queries.

Each role comes with the SQL that builds the same rows, so a query and its check start from equal input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, its SQL check."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as job records."""
    status = F.col("o_orderstatus")
    running = status != "O"
    finished = (status == "F") & (F.col("o_totalprice") > 200000)
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_custkey").alias("group_id"),
        F.when(status == "P", "RUNNING").when(status == "F", "COMPLETED").alias("last_status"),
        F.when(finished, "finished").alias("final_state"),
        F.when(finished, F.col("o_orderdate")).alias("end_ts"),
        running.alias("submitted"),
        priority.alias("attempts"),
        priority.alias("array_len"),
        F.when(running, F.concat(F.lit("r"), F.col("o_orderkey"))).alias("runtime_job_id"),
        F.col("o_orderdate").alias("start_ts"),
        F.lit("logs/%A/%a_%j_%t.log").alias("log_path"),
    )


JOBS_SQL = """jobs AS (
  SELECT o_orderkey AS job_id, o_orderpriority AS name, o_custkey AS group_id,
    CASE o_orderstatus WHEN 'P' THEN 'RUNNING' WHEN 'F' THEN 'COMPLETED' END AS last_status,
    CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'finished' END AS final_state,
    CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN o_orderdate END AS end_ts,
    o_orderstatus <> 'O' AS submitted,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS attempts,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS array_len,
    CASE WHEN o_orderstatus <> 'O' THEN 'r' || o_orderkey END AS runtime_job_id,
    o_orderdate AS start_ts, 'logs/%A/%a_%j_%t.log' AS log_path
  FROM orders)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status snapshots of users."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("runtime_job_id"), "ts", "event_id", F.col("event_type").alias("status")
    )


SNAPSHOTS_SQL = "snapshots AS (SELECT user_id AS runtime_job_id, ts, event_id, event_type AS status FROM events)"


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as logs of one chunk each."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), "text")


def turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs of one chunk per turn, a second apart."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("job_id"),
        F.col("turn").alias("chunk_seq"),
        F.timestamp_seconds("turn").alias("ts"),
        "text",
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as marker files."""
    return table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
