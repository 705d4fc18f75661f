"""The job registry as a table: scan, upsert, remove, finish, rules and array expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.lifecycle import TERMINAL
from tidewatch.schemas import JOB_RECORD


def read_records(spark: SparkSession, path: str, files: str = "*.job.json", lines: bool = False) -> DataFrame:
    """Every record below ``path``, readable or not: one per file, or one per line with ``lines``.

    Older records are mapped to the present shape. Many jobs are better kept as lines of few files.
    """
    raw = (
        spark.read.schema(JOB_RECORD)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("pathGlobFilter", files)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    return raw.withColumn("definition", F.coalesce("definition", "registration")).drop("registration")


def scan(records: DataFrame, include_finished: bool = False) -> DataFrame:
    """Readable records, by default of unfinished jobs only."""
    good = records.filter(F.col("_corrupt_record").isNull() & F.col("job_id").isNotNull()).drop("_corrupt_record")
    return good if include_finished else good.filter(F.col("runtime.final_state").isNull())


def quarantine(records: DataFrame) -> DataFrame:
    """Records that could not be read."""
    return records.filter(F.col("_corrupt_record").isNotNull() | F.col("job_id").isNull())


def flatten(records: DataFrame) -> DataFrame:
    """The flat ``jobs`` table of the other functions."""
    return records.select(
        "job_id", "array_idx", "schema_version", "definition.*", *[F.col(f"runtime.{c}") for c in RUNTIME_FIELDS]
    )


RUNTIME_FIELDS = (
    "submitted",
    "attempts",
    "runtime_job_id",
    "start_ts",
    "end_ts",
    "log_cursor",
    "condition_state",
    "action_state",
    "last_status",
    "final_state",
)


def valid_json(column: Column) -> Column:
    """True for text that parses as JSON, false otherwise and for NULL."""
    return F.try_parse_json(column).isNotNull()


def lookup(jobs: DataFrame, job_id, include_finished: bool = False) -> DataFrame:
    found = jobs.filter(F.col("job_id") == F.lit(job_id))
    return found if include_finished else found.filter(F.col("final_state").isNull())


def upsert(writes: DataFrame, key: str = "job_id", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Last write of each key, whole row. Reduced on the map side, so a key written often is cheap."""
    rest = [c for c in writes.columns if c != key]
    last = writes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return last.select(key, "row.*")


def submit(jobs: DataFrame, payloads: DataFrame, key: str = "job_id", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Registry after submitting or replacing jobs."""
    return upsert(jobs.unionByName(payloads, allowMissingColumns=True), key, order)


def remove(jobs: DataFrame, doomed: DataFrame, key: str = "job_id") -> DataFrame:
    return jobs.join(doomed.select(key), key, "left_anti")


def mark_finished(jobs: DataFrame, completions: DataFrame) -> DataFrame:
    """Set final_state and end_ts from ``completions(job_id, state, at)``; finished jobs stay as they are."""
    done = completions.groupBy("job_id").agg(F.min_by(F.struct("state", "at"), F.struct("at", "state")).alias("__c"))
    takes = F.col("final_state").isNull() & F.col("__c.state").isNotNull()
    return (
        jobs.join(done, "job_id", "left")
        .withColumns(
            {
                "final_state": F.when(takes, F.col("__c.state")).otherwise(F.col("final_state")),
                "end_ts": F.when(takes, F.col("__c.at")).otherwise(F.col("end_ts")),
            }
        )
        .drop("__c")
    )


def log_rules(jobs: DataFrame) -> DataFrame:
    """Log rules as rows; those without an action are left out, but keep their place in the numbering."""
    rows = jobs.select("job_id", F.posexplode("log_events").alias("rule_idx", "rule"))
    return rows.filter(F.col("rule.action").isNotNull()).select("job_id", "rule_idx", "rule.*")


def state_rules(jobs: DataFrame) -> DataFrame:
    rows = jobs.select("job_id", F.posexplode("state_events").alias("rule_idx", "rule"))
    return rows.filter(F.col("rule.action").isNotNull()).select(
        "job_id",
        "rule_idx",
        F.get("rule.transition", F.lit(0)).alias("old"),
        F.get("rule.transition", F.lit(1)).alias("new"),
        "rule.name",
        "rule.metadata",
        "rule.action",
        "rule.condition",
    )


def array_len(array_args: Column) -> Column:
    """Number of tasks of an array job, at least one."""
    return F.greatest(F.lit(1), F.coalesce(F.size(array_args), F.lit(0)))


def expand_arrays(jobs: DataFrame, ids: Column | None = None, started: Column | None = None) -> DataFrame:
    """One row per array task with id ``job_idx``; plain jobs pass through.

    ``ids`` are the runtime ids the submission gave, in order; tasks beyond them do not come to be, and an array job for
    which none came back stays as it is. A task is submitted and at the next attempt, with its own runtime id, its log
    unread and ``started`` as its start, as far as the jobs have these columns.
    """
    length = F.greatest(F.lit(1), F.coalesce(F.col("array_len"), F.lit(1)))
    given = F.lit(None).cast("array<string>") if ids is None else ids
    whole = F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("id")))

    def tasks(v: Column) -> Column:
        count = length if ids is None else F.least(length, F.coalesce(F.size(v), F.lit(0)))
        each = F.zip_with(F.sequence(F.lit(0), length - 1), F.coalesce(v, F.array().cast("array<string>")), lambda i, d: F.struct(i.alias("i"), d.alias("id")))
        return F.when((length > 1) & (count > 0), F.slice(each, 1, count)).otherwise(whole)

    # The ids are worked out once per job: inside the generator and, by the one-element array, once there.
    rows = jobs.withColumn("__task", F.explode(F.transform(F.array(given), tasks)[0]))
    rows = rows.withColumn("array_idx", F.col("__task.i"))
    task = F.col("array_idx").isNotNull()
    fresh = {
        "attempts": F.col("attempts") + 1 if "attempts" in jobs.columns else None,
        "submitted": F.lit(True),
        "runtime_job_id": F.col("__task.id"),
        "log_cursor": F.lit(0),
        "start_ts": started,
    }
    changed = {
        name: F.when(task, value.cast(jobs.schema[name].dataType)).otherwise(F.col(name))
        for name, value in fresh.items()
        if name in jobs.columns and value is not None
    }
    rows = rows.withColumns(changed).drop("__task")
    task_id = F.concat_ws("_", F.col("job_id").cast("string"), F.col("array_idx").cast("string"))
    return rows.withColumn("job_id", task_id)


def cleanup(jobs: DataFrame, done_only: bool = False, scope: str = "active") -> tuple[DataFrame, DataFrame]:
    """(removed, kept) rows of a retention run.

    ``active`` looks at unfinished jobs only and so never removes jobs that have ended; ``all`` does.
    """
    if scope not in ("active", "all"):
        raise ValueError("scope must be active or all")
    doomed = F.lit(True)
    if done_only:
        doomed = F.coalesce(F.col("last_status").isin(*TERMINAL), F.lit(False))
        if scope == "all":
            doomed = doomed | F.col("final_state").isNotNull()
    if scope == "active":
        doomed = doomed & F.col("final_state").isNull()
    return jobs.filter(doomed), jobs.filter(~doomed)


def write_registry(jobs: DataFrame, path: str) -> None:
    """Write a registry snapshot laid out so that scans of unfinished jobs read nothing else."""
    shelf = F.when(F.col("final_state").isNull(), "open").otherwise("finished")
    jobs.withColumn("shelf", shelf).write.mode("overwrite").partitionBy("shelf").parquet(path)


def read_registry(spark: SparkSession, path: str, include_finished: bool = False) -> DataFrame:
    """A written snapshot, by default its unfinished jobs."""
    jobs = spark.read.parquet(path)
    return (jobs if include_finished else jobs.filter(F.col("shelf") == "open")).drop("shelf")
