"""Summaries of jobs and events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a status report.
REPORT_COLUMNS = ("job_id", "name", "attempts", "submitted", "runtime_job_id", "last_status", "log_path")


def event_rollup(
    events: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("ts", "seq"),
    payload: Mapping[str, str] | None = None,
) -> DataFrame:
    """Count, first and last time of each event, and per payload key its latest value.

    ``payload`` maps a column to its name in the result.
    """
    place = F.struct(*order)
    latest = [
        F.max_by(column, F.when(F.col(column).isNotNull(), place)).alias(name)
        for column, name in (payload or {}).items()
    ]
    return events.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.min(order[0]).alias("first_seen_ts"),
        F.max(order[0]).alias("last_seen_ts"),
        *latest,
    )


def event_history(events: DataFrame, keys: Sequence[str], note: Column) -> DataFrame:
    """Notes on events as rows; a long history is never one value."""
    return events.select(*keys, "ts", note.alias("note")).filter(F.col("note").isNotNull() & (F.col("note") != ""))


def status_report(jobs: DataFrame, as_json: bool = False, as_text: bool = False) -> DataFrame:
    """Unfinished jobs in seven columns, or as one JSON or text line each."""
    rows = jobs.filter(F.col("final_state").isNull()).select(*REPORT_COLUMNS)
    if as_json:
        return rows.select("job_id", F.to_json(F.struct(*REPORT_COLUMNS), {"ignoreNullFields": "false"}).alias("line"))
    if as_text:
        return rows.select("job_id", status_line().alias("line"))
    return rows


def status_line() -> Column:
    flag = F.when(F.col("submitted"), "True").otherwise("False")
    return F.concat(
        F.lit("- "),
        F.col("job_id").cast("string"),
        F.lit(" "),
        F.coalesce("name", F.lit("")),
        F.lit(" status="),
        F.coalesce("last_status", F.lit("None")),
        F.lit(" attempts="),
        F.col("attempts").cast("string"),
        F.lit(" submitted="),
        flag,
    )


def status_counts(jobs: DataFrame) -> DataFrame:
    """Number of jobs by last status."""
    return jobs.groupBy("last_status").agg(F.count("*").alias("jobs"))


def poll_snapshot(jobs: DataFrame, status: DataFrame, finishing: Column) -> DataFrame:
    """State of each open job at a poll: pending, or its current status. Jobs about to finish are left out."""
    open_jobs = jobs.filter(F.col("final_state").isNull()).filter(~F.coalesce(finishing, F.lit(False)))
    seen = status.select("runtime_job_id", F.col("status").alias("__status"))
    state = F.when(~F.col("submitted"), "pending").otherwise(F.col("__status"))
    return open_jobs.join(seen, "runtime_job_id", "left").select("job_id", state.alias("state"), "attempts")
