"""Queries that run as streams over all given rows and hand back what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.operators.actions import Action
from tidewatch.operators.conditions import Cooldown, MaxAttempts
from tidewatch.operators.lifecycle import Spec, end_states, replay, trigger_rows
from tidewatch.operators.rules import LogRule
from tidewatch.plans.status import CHANGES_SQL
from tidewatch.plans.tables import query, table
from tidewatch.session import materialise, scratch_path
from tidewatch.streaming import jobs as streaming
from tidewatch.streaming import snapshots

DAY = 86400
SPEC = Spec(
    log_rules=[
        LogRule("failed", "error", action=Action("LogAction"), condition=Cooldown(cooldown_seconds=DAY)),
        LogRule("again", "signup", action=Action("RestartAction"), condition=MaxAttempts(max_attempts=3)),
    ]
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.read_stream(spark, f"{sf_dir}/events.parquet")


STATE_SQL = """WITH RECURSIVE n AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id
      ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('error', 'signup')),
    r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 1 AS attempts, CAST(NULL AS TIMESTAMP) AS last,
        CAST(-1 AS BIGINT) AS event_id, false AS fired FROM n
      UNION ALL SELECT r.user_id, n.k, CASE WHEN event_type = 'signup' AND attempts < 3 THEN attempts + 1 ELSE attempts END,
        CASE WHEN event_type = 'error' AND (last IS NULL OR ts - last >= INTERVAL 24 HOUR) THEN ts ELSE last END,
        n.event_id, CASE WHEN event_type = 'signup' THEN attempts < 3 ELSE last IS NULL OR ts - last >= INTERVAL 24 HOUR END
      FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
    SELECT CAST(user_id AS VARCHAR) AS job_id, event_id, fired, attempts FROM r JOIN n USING (user_id, k, event_id)"""


def _triggers(events: DataFrame) -> DataFrame:
    idx = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 1)
    # The place of an event in its user's log is its time; ids are unique and come after it.
    chosen = events.filter(F.col("event_type").isin("error", "signup")).select(
        F.col("user_id").alias("job_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("chunk_seq"),
        idx.alias("rule_idx"),
        F.col("event_id").cast("int").alias("match_seq"),
        "ts",
    )
    return trigger_rows(chosen, SPEC)


@query("job_stream_state", STATE_SQL)
def job_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors fire once a day, signups restart up to three attempts; each event is a poll of its own."""
    marks = streaming.marks_folder(spark)
    stream = streaming.job_decisions(_triggers(_events(spark, sf_dir)), SPEC, marks=marks)
    done = streaming.drain(spark, stream, "job-stream", marks=marks)
    return done.select("job_id", F.col("match_seq").cast("long").alias("event_id"), "fired", "attempts")


@query("stream_resume", STATE_SQL)
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the events as a batch; a stream over the second goes on from where its jobs then stand."""
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("low"), F.unix_micros(F.max("ts").cast("timestamp")).alias("high")).first()
    early = F.unix_micros(F.col("ts").cast("timestamp")) < (ends["low"] + ends["high"]) // 2
    first = materialise(replay(_triggers(events.filter(early)), SPEC), "early")
    states = materialise(end_states(first, SPEC), "early-states")
    marks = streaming.marks_folder(spark)
    stream = streaming.job_decisions(_triggers(_events(spark, sf_dir).filter(~early)), SPEC, marks=marks, initial=states)
    second = streaming.drain(spark, stream, "late-half", marks=marks)
    shared = ["job_id", "match_seq", "fired", "attempts"]
    both = first.select(F.col("job_id").cast("string").alias("job_id"), *shared[1:]).unionByName(second.select(*shared))
    return both.select("job_id", F.col("match_seq").cast("long").alias("event_id"), "fired", "attempts")


TRANSITIONS_SQL = f"""WITH {CHANGES_SQL} SELECT CAST(runtime_job_id AS VARCHAR) AS runtime_job_id, epoch_us(ts) AS us,
      event_id AS seq, old_status, new_status, transition FROM changes"""


@query("stream_interval", TRANSITIONS_SQL)
def polled_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes by a stream that polls every second, up to when nothing is left."""
    return transitions(spark, sf_dir, every="1 second")


@query("stream_transitions", TRANSITIONS_SQL)
def transitions(spark: SparkSession, sf_dir: str, every: str | None = None) -> DataFrame:
    feed = _events(spark, sf_dir).select(
        F.col("user_id").alias("runtime_job_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("status"),
    )
    marks = streaming.marks_folder(spark)
    return streaming.drain(spark, streaming.stream_transitions(feed, marks=marks), "transitions", marks=marks, every=every)


@query(
    "stream_timeout",
    f"""WITH t AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(min(ts)) AS since_us FROM events GROUP BY 1)
    SELECT key, since_us, since_us + {20 * DAY * 1000000} AS until_us FROM t
    WHERE since_us // 1000 + {20 * DAY * 1000} <= (SELECT epoch_us(max(ts)) // 1000 FROM events)""",
)
def timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users twenty days after their first event, up to the last event."""
    marks = streaming.marks_folder(spark)
    stream = streaming.stream_timeouts(_events(spark, sf_dir), "user_id", 20 * DAY, marks=marks)
    return streaming.drain(spark, stream, "timeouts", marks=marks)


@query(
    "stream_inactivity",
    f"""WITH t AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS since_us,
      lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until_us FROM events)
    SELECT key, since_us, until_us FROM t WHERE until_us - since_us > {DAY * 1000000} OR (until_us IS NULL
      AND (since_us + {DAY * 1000000}) // 1000 + 1 <= (SELECT epoch_us(max(ts)) // 1000 FROM events))""",
)
def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of more than a day, those that are open for as long at the last event included.

    A silence that is told while it lasts is told again with its end; the table keeps what was told last.
    """
    marks = streaming.marks_folder(spark)
    stream = streaming.stream_inactivity(_events(spark, sf_dir), "user_id", DAY, marks=marks)
    told = streaming.drain(spark, stream, "silences", marks=marks)
    return told.groupBy("key", "since_us").agg(F.max("until_us").alias("until_us"))


@query(
    "registry_stream_upsert",
    """SELECT user_id AS job_id, arg_max(event_id, (ts, event_id)) AS seq, max(ts) AS ts,
      arg_max(event_type, (ts, event_id)) AS last_status, arg_max(value, (ts, event_id)) AS value
    FROM events GROUP BY user_id""",
)
def registry_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of writes in four files, merged into a snapshot; the last file's batch is merged twice."""
    feed, schema = _cut_events(spark, sf_dir)
    renamed = [F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("last_status"), "value"]
    writes = feed.select(*renamed)
    path = scratch_path(spark, "snapshot")
    query = snapshots.keep_snapshot(writes, path, f"{path}-checkpoint")
    query.awaitTermination()
    snapshots.merge_batch(spark.read.schema(schema).parquet(f"{sf_dir}/events.parquet").select(*renamed), 3, path)
    return snapshots.read_snapshot(spark, path, writes.schema)


@query(
    "stream_late",
    """WITH e AS (SELECT event_id, ts, event_id % 4 AS file FROM events),
    marks AS (SELECT file, max(ts) - INTERVAL 10 DAY AS upto FROM e GROUP BY file)
    SELECT event_id, CAST(file AS BIGINT) AS batch FROM e
    WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(upto)) FROM marks WHERE marks.file < e.file)""",
)
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four files: those that come ten days or more behind the files before."""
    feed, schema = _cut_events(spark, sf_dir)
    path = scratch_path(spark, "late")
    snapshots.write_late(feed, path, f"{path}-checkpoint", late="10 days").awaitTermination()
    return snapshots.read_late(spark, path, schema).select("event_id", "batch")


def _cut_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, StructType]:
    """The events as a feed of four files, one to a micro-batch, dealt by event_id."""
    events = table(spark, sf_dir, "events")
    folder = scratch_path(spark, "event-files")
    for part in range(4):
        events.filter(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return feed, events.schema
