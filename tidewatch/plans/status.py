"""Queries on status feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.render import status_from_return_code
from tidewatch.operators.actions import Action
from tidewatch.operators.lifecycle import all_events
from tidewatch.operators.matching import match_triggers
from tidewatch.operators.rules import LogRule, StateRule
from tidewatch.operators.transitions import (
    attach_status,
    inactivity_gaps,
    latest_status,
    match_state_rules,
    merge_status,
    status_at_chunk,
    status_changes,
    status_changes_with_missing,
)
from tidewatch.plans.tables import SNAPSHOTS_SQL, query, snapshots, table

NOTE = Action("LogAction", "{transition}")
STATE_RULES = [
    StateRule("to_error", None, "error", action=NOTE),
    StateRule("ignored", "view", "click"),
    StateRule("bought", "click", "purchase", action=NOTE),
    StateRule("left_signup", "signup", None, action=NOTE),
    StateRule("any", action=NOTE),
]

CHANGES_SQL = f"""{SNAPSHOTS_SQL}, seen AS (
  SELECT *, lag(status) OVER (PARTITION BY runtime_job_id ORDER BY ts, event_id) AS old_status FROM snapshots),
changes AS (SELECT runtime_job_id, ts, event_id, old_status, status AS new_status,
  coalesce(old_status, 'None') || ' -> ' || coalesce(status, 'None') AS transition
  FROM seen WHERE old_status IS DISTINCT FROM status)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_changes(snapshots(spark, sf_dir), order=["ts", "event_id"])


@query("state_transitions", f"WITH {CHANGES_SQL} SELECT * FROM changes")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select(
        "runtime_job_id", "ts", "event_id", "old_status", "new_status", "transition"
    )


@query(
    "state_rule_match",
    f"""WITH {CHANGES_SQL}, rules(rule_idx, rule_name, old, new) AS (VALUES
      (0, 'to_error', NULL, 'error'), (2, 'bought', 'click', 'purchase'), (3, 'left_signup', 'signup', NULL),
      (4, 'any', NULL, NULL))
    SELECT runtime_job_id, event_id, rule_idx, rule_name, transition FROM changes JOIN rules
      ON (old IS NULL OR old = old_status) AND (new IS NULL OR new = new_status)""",
)
def state_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match_state_rules(changes(spark, sf_dir), STATE_RULES)
    return hits.select("runtime_job_id", "event_id", "rule_idx", "rule_name", "transition")


LATEST_SQL = """SELECT runtime_job_id, arg_max(status, (ts, event_id)) AS status"""


@query(
    "status_attach",
    f"""WITH {SNAPSHOTS_SQL}, latest AS ({LATEST_SQL} FROM snapshots GROUP BY 1)
    SELECT c_custkey AS runtime_job_id, c_mktsegment AS name, status FROM customer
    LEFT JOIN latest ON c_custkey = runtime_job_id""",
)
def status_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("runtime_job_id"), F.col("c_mktsegment").alias("name")
    )
    return attach_status(jobs, latest_status(snapshots(spark, sf_dir), ["ts", "event_id"]))


def _two_feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots of two backends: orders' own states by customer, and the event feed by user."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("runtime_job_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderstatus").alias("status"),
    )
    return orders, snapshots(spark, sf_dir)


@query(
    "status_merge",
    f"""WITH {SNAPSHOTS_SQL}, second AS ({LATEST_SQL} FROM snapshots GROUP BY 1),
    first AS (SELECT o_custkey AS runtime_job_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status
      FROM orders GROUP BY 1)
    SELECT runtime_job_id, coalesce(second.status, first.status) AS status
    FROM first FULL JOIN second USING (runtime_job_id)""",
)
def status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (latest_status(feed, ["ts", "event_id"]) for feed in _two_feeds(spark, sf_dir))
    return merge_status(first, second)


@query(
    "status_from_return_code",
    """SELECT l_orderkey, l_linenumber,
      CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'PENDING' WHEN l_returnflag = 'A' THEN 'RUNNING'
        WHEN l_returnflag = 'N' THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM lineitem""",
)
def return_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1)
    has_process = ~((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"))
    status = status_from_return_code(has_process, code, F.lit("PENDING"))
    return items.select("l_orderkey", "l_linenumber", status.alias("status"))


@query(
    "chunk_status_asof",
    f"""WITH {SNAPSHOTS_SQL}, chunks AS (SELECT * FROM snapshots WHERE status = 'view'),
    feed AS (SELECT * FROM snapshots WHERE status <> 'view')
    SELECT c.runtime_job_id AS job_id, c.event_id, f.status FROM chunks c ASOF LEFT JOIN feed f
      ON c.runtime_job_id = f.runtime_job_id AND c.ts >= f.ts""",
)
def chunk_status_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir).withColumnRenamed("runtime_job_id", "job_id")
    chunks = rows.filter(F.col("status") == "view")
    feed = rows.filter(F.col("status") != "view")
    return status_at_chunk(chunks, feed, ["event_id"]).drop("ts")


@query(
    "inactivity_gaps",
    """WITH seen AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
      FROM events)
    SELECT user_id, event_id, before AS silent_from, ts AS silent_until,
      epoch_us(ts) - epoch_us(before) AS gap_us FROM seen WHERE ts - before > INTERVAL 24 HOUR""",
)
def inactivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = inactivity_gaps(table(spark, sf_dir, "events"), 86400, "user_id", ["ts", "event_id"])
    return gaps.select("user_id", "event_id", "silent_from", "silent_until", "gap_us")


DAILY_SQL = """daily AS (SELECT user_id AS runtime_job_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts,
      arg_max(event_type, (ts, event_id)) AS status FROM events WHERE event_type <> 'view' GROUP BY 1, 2)"""


@query(
    "state_transitions_missing",
    f"""WITH {DAILY_SQL}, spans AS (SELECT runtime_job_id, min(ts) AS lo FROM daily GROUP BY 1),
    grid AS (SELECT runtime_job_id, ts FROM spans JOIN (SELECT DISTINCT ts FROM daily) ON ts >= lo),
    filled AS (SELECT grid.runtime_job_id, grid.ts, status FROM grid LEFT JOIN daily USING (runtime_job_id, ts)),
    seen AS (SELECT *, lag(status) OVER (PARTITION BY runtime_job_id ORDER BY ts) AS old_status FROM filled)
    SELECT runtime_job_id, ts, old_status, status AS new_status,
      coalesce(old_status, 'None') || ' -> ' || coalesce(status, 'None') AS transition
    FROM seen WHERE old_status IS DISTINCT FROM status""",
)
def transitions_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily polls; a user with nothing but views on a day was missing from that poll."""
    daily = (
        snapshots(spark, sf_dir)
        .filter(F.col("status") != "view")
        .groupBy("runtime_job_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
        .agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
        .withColumnRenamed("day", "ts")
    )
    found = status_changes_with_missing(daily, daily.select("ts"))
    return found.select("runtime_job_id", "ts", "old_status", "new_status", "transition")


LOG_NOTES = [
    LogRule("nine", '9}', action=Action("RestartAction")),
    LogRule("digits", '"k": ([0-9])[0-9]}', "regex", action=Action("LogAction", "{match}")),
]


@query(
    "all_events",
    f"""WITH {CHANGES_SQL}, rules(rule_idx, rule_name, old, new) AS (VALUES
      (0, 'to_error', NULL, 'error'), (2, 'bought', 'click', 'purchase'), (3, 'left_signup', 'signup', NULL),
      (4, 'any', NULL, NULL)),
    states AS (SELECT runtime_job_id AS job_id, event_id, rule_idx, rule_name, 'state' AS source, NULL AS effect
      FROM changes JOIN rules ON (old IS NULL OR old = old_status) AND (new IS NULL OR new = new_status)),
    logs AS (
      SELECT user_id AS job_id, event_id, 0 AS rule_idx, 'nine' AS rule_name, 'log' AS source, 'restart' AS effect
      FROM events WHERE contains(props, '9}}')
      UNION ALL SELECT user_id, event_id, 1, 'digits', 'log', 'noop' FROM events
      WHERE regexp_matches(props, '"k": ([0-9])[0-9]}}'))
    SELECT *, source || ':' || rule_name || ':' || rule_idx AS action_id FROM
      (SELECT * FROM logs UNION ALL SELECT * FROM states)""",
)
def all_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), "event_id", F.col("props").alias("text")
    )
    effect = F.when(F.col("rule_idx") == 0, "restart").otherwise("noop")
    logs = match_triggers(events, LOG_NOTES, ["job_id", "event_id"], payload=False).withColumn("effect", effect)
    states = match_state_rules(changes(spark, sf_dir), STATE_RULES).withColumnRenamed("runtime_job_id", "job_id")
    merged = all_events(logs, states)
    action_id = F.concat_ws(":", "source", "rule_name", F.col("rule_idx").cast("string"))
    return merged.select("job_id", "event_id", "rule_idx", "rule_name", "source", "effect", action_id.alias("action_id"))
