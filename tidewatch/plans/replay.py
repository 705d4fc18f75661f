"""Queries that replay jobs over their triggers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.actions import Action
from tidewatch.operators.conditions import Cooldown, MaxAttempts
from tidewatch.operators.lifecycle import (
    Spec,
    chunk_effects,
    chunk_stops,
    close_jobs,
    effect_column,
    end_states,
    job_ends,
    job_outcomes,
    replay,
    replay_fold,
    trigger_rows,
)
from tidewatch.operators.matching import match_triggers
from tidewatch.operators.registry_replay import (
    registry_actions,
    registry_after,
    registry_hits,
    replay_registry,
)
from tidewatch.operators.rules import LogRule
from tidewatch.plans.tables import query, table, turn_chunks
from tidewatch.schemas import LOG_EVENT, STATE_EVENT
from tidewatch.session import materialise

RESTART, FINISH, CANCEL = Action("RestartAction"), Action("FinishAction"), Action("CancelAction")
NOTE = Action("LogAction", "{match}")

GATED = Spec(
    log_rules=[
        LogRule("stuck", "^Er", "regex", RESTART, condition=MaxAttempts(max_attempts=3)),
        LogRule("done", "heit", action=FINISH),
        LogRule("fatal", "^Un", "regex", CANCEL),
        LogRule("progress", "tion", action=NOTE, condition=Cooldown(cooldown_seconds=2)),
    ]
)
PLAIN = Spec(
    log_rules=[
        LogRule("stuck", "^Er", "regex", RESTART, match_once=False),
        LogRule("done", "heit", action=FINISH),
        LogRule("fatal", "^Un", "regex", CANCEL),
        LogRule("progress", "tion", action=NOTE, match_once=False),
    ]
)


def _hits(once: bool) -> str:
    """Hits of the four rules, named ``hits``."""
    cut = "[1:1]" if once else ""
    single = "[1:1]"
    parts = []
    for idx, (pattern, c) in enumerate((("(?m)^Er", cut), ("heit", single), ("(?m)^Un", single), ("tion", cut))):
        parts.append(
            f"""SELECT job_id, chunk_seq, {idx} AS rule_idx, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS match_seq
      FROM (SELECT conv_id AS job_id, turn AS chunk_seq, regexp_extract_all(text, '{pattern}'){c} AS m FROM conversations)
      WHERE len(m) > 0"""
        )
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


def _rows(spark: SparkSession, sf_dir: str, spec: Spec, cut: bool = False) -> DataFrame:
    hits = match_triggers(turn_chunks(spark, sf_dir), spec.log_rules, payload=False, cut_after_effect=cut)
    return trigger_rows(hits, spec)


STOPS_SQL = f"""{_hits(False)}, stops AS (SELECT job_id, chunk_seq, min((rule_idx, match_seq)) AS stop FROM hits
  WHERE rule_idx < 3 GROUP BY 1, 2),
kept AS (SELECT hits.*, coalesce((rule_idx, match_seq) = stop, false) AS stops FROM hits
  LEFT JOIN stops USING (job_id, chunk_seq) WHERE stop IS NULL OR (rule_idx, match_seq) <= stop)"""


@query("chunk_effect", f"WITH {STOPS_SQL} SELECT job_id, chunk_seq, rule_idx, match_seq, stops FROM kept")
def chunk_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is evaluated in each turn: everything up to the first restart, finish or cancel."""
    rows = materialise(_rows(spark, sf_dir, PLAIN), "triggers")
    kept = chunk_effects(rows, chunk_stops(rows, effect_column(PLAIN), F.lit(True)))
    return kept.select("job_id", "chunk_seq", "rule_idx", "match_seq", F.col("chunk_stop").alias("stops"))


CLOSED_SQL = f"""{STOPS_SQL}, ends AS (SELECT job_id, min((chunk_seq, rule_idx, match_seq)) AS fin FROM kept
  WHERE stops AND rule_idx IN (1, 2) GROUP BY 1),
open_rows AS (SELECT kept.* FROM kept LEFT JOIN ends USING (job_id)
  WHERE fin IS NULL OR (chunk_seq, rule_idx, match_seq) <= fin)"""


@query("lifecycle_close", f"WITH {CLOSED_SQL} SELECT job_id, chunk_seq, rule_idx, match_seq FROM open_rows")
def lifecycle_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(_rows(spark, sf_dir, PLAIN), "triggers")
    stops = chunk_stops(rows, effect_column(PLAIN), F.lit(True))
    kept = close_jobs(chunk_effects(rows, stops), job_ends(rows, stops))
    return kept.select("job_id", "chunk_seq", "rule_idx", "match_seq")


@query(
    "lifecycle_replay_stateless",
    f"""WITH {CLOSED_SQL} SELECT job_id, chunk_seq, rule_idx, match_seq,
      CAST(1 + sum(CASE WHEN rule_idx = 0 AND stops THEN 1 ELSE 0 END) OVER (PARTITION BY job_id
        ORDER BY chunk_seq, rule_idx, match_seq) AS INTEGER) AS attempts,
      CASE WHEN stops AND rule_idx = 1 THEN 'finished' WHEN stops AND rule_idx = 2 THEN 'cancelled' END AS outcome
    FROM open_rows""",
)
def lifecycle_replay_stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without remembered state: answered by windows and aggregates alone."""
    done = replay(_rows(spark, sf_dir, PLAIN, cut=True), PLAIN)
    return done.select("job_id", "chunk_seq", "rule_idx", "match_seq", "attempts", "outcome")


REPLAY_SQL = f"""WITH RECURSIVE {_hits(True)},
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY chunk_seq, rule_idx) AS k FROM hits),
r AS (
  SELECT DISTINCT conv_id AS job_id, CAST(0 AS BIGINT) AS k, 1 AS attempts, CAST(NULL AS VARCHAR) AS outcome,
    CAST(-1 AS BIGINT) AS closed, CAST(-1000 AS BIGINT) AS said, 0 AS fired FROM conversations
  UNION ALL
  SELECT job_id, next_k,
    CASE WHEN live AND rule_idx = 0 AND attempts < 3 THEN attempts + 1 ELSE attempts END,
    CASE WHEN live AND rule_idx = 1 THEN 'finished' WHEN live AND rule_idx = 2 THEN 'cancelled' ELSE outcome END,
    CASE WHEN live AND rule_idx = 0 AND attempts < 3 THEN chunk_seq ELSE closed END,
    CASE WHEN live AND rule_idx = 3 AND chunk_seq - said >= 2 THEN chunk_seq ELSE said END,
    fired + CASE WHEN live AND (rule_idx IN (1, 2) OR (rule_idx = 0 AND attempts < 3)
      OR (rule_idx = 3 AND chunk_seq - said >= 2)) THEN 1 ELSE 0 END
  FROM (SELECT r.*, n.k AS next_k, rule_idx, chunk_seq, outcome IS NULL AND closed <> chunk_seq AS live
    FROM r JOIN n ON n.job_id = r.job_id AND n.k = r.k + 1))
SELECT job_id, arg_max(attempts, k) AS attempts, arg_max(outcome, k) AS final_state, CAST(max(fired) AS BIGINT) AS fired
FROM r GROUP BY 1"""


@query("lifecycle_replay", REPLAY_SQL)
def lifecycle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restarts limited to three attempts, a finish, a cancel, and a message with a cooldown of two turns."""
    done = replay(_rows(spark, sf_dir, GATED, cut=True), GATED)
    all_jobs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"))
    return job_outcomes(done, all_jobs)


@query("lifecycle_resume", REPLAY_SQL)
def lifecycle_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two runs: the second half of each conversation goes on from what the first left."""
    rows = materialise(_rows(spark, sf_dir, GATED, cut=True), "resume-rows")
    half = F.col("chunk_seq") < 4
    first = materialise(replay_fold(rows.filter(half), GATED).filter("evaluated"), "resume-first")
    states = end_states(first, GATED)
    second = replay_fold(rows.filter(~half), GATED, initial=states).filter("evaluated")
    all_jobs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"))
    return job_outcomes(first.unionByName(second), all_jobs)


SHORT_RULES = [
    {
        "name": "stuck",
        "pattern": "^Er",
        "pattern_type": "regex",
        "action": {"class_name": "RestartAction"},
        "condition": {"class_name": "MaxAttemptsCondition", "max_attempts": 3},
    },
    {"name": "done", "pattern": "heit", "action": {"class_name": "FinishAction"}},
]
LONG_RULES = [
    {"name": "fatal", "pattern": "^Un", "pattern_type": "regex", "action": {"class_name": "CancelAction"}},
    {
        "name": "progress",
        "pattern": "tion",
        "action": {"class_name": "LogAction"},
        "condition": {"class_name": "CooldownCondition", "cooldown_seconds": 2},
    },
]
# The same recursion; hits of rules that are not the job's own are left out.
REGISTRY_SQL = REPLAY_SQL.replace(
    "FROM hits)",
    """FROM hits JOIN (SELECT conv_id AS job_id, count(*) > 5 AS long FROM conversations GROUP BY 1) USING (job_id)
    WHERE long = (rule_idx >= 2))""",
)


def _registry(spark: SparkSession, sf_dir: str, long_rules: list[dict] = LONG_RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, log text and polls: long conversations have other rules than short ones."""
    turns = turn_chunks(spark, sf_dir)
    none = F.lit(None).cast("string")

    def rules(items: list[dict]):
        return F.from_json(F.lit(json.dumps(items)), T.ArrayType(LOG_EVENT))

    jobs = turns.groupBy("job_id").agg(F.count("*").alias("turns")).select(
        "job_id",
        F.lit("talk").alias("name"),
        F.lit("LocalJob").alias("class_name"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.when(F.col("turns") > 5, rules(long_rules)).otherwise(rules(SHORT_RULES)).alias("log_events"),
        F.lit(None).cast(T.ArrayType(STATE_EVENT)).alias("state_events"),
        *[none.alias(f"{label}_condition") for label in ("start", "cancel", "finish")],
        F.lit(True).alias("submitted"),
        F.lit(1).alias("attempts"),
    )
    polls = turns.select("job_id", "chunk_seq", "ts", F.lit("RUNNING").alias("status"), F.lit(True).alias("submit_ok"))
    return jobs, turns, polls


@query("registry_replay", REGISTRY_SQL)
def registry_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_outcomes(replay_registry(*_registry(spark, sf_dir)))


RULE_SQL = "CASE rule_idx WHEN 0 THEN '{}' WHEN 1 THEN '{}' WHEN 2 THEN '{}' ELSE '{}' END"


@query(
    "registry_messages",
    REGISTRY_SQL.replace(
        "SELECT job_id, arg_max(attempts, k) AS attempts, arg_max(outcome, k) AS final_state, CAST(max(fired) AS BIGINT) AS fired\nFROM r GROUP BY 1",
        f"""SELECT r.job_id, chunk_seq, {RULE_SQL.format('stuck', 'done', 'fatal', 'progress')} AS rule_name,
      {RULE_SQL.format('restart', 'finish', 'cancel', 'noop')} AS effect,
      {RULE_SQL.format('restarting job', 'finished', 'cancelled', 'Event progress triggered')} AS message
    FROM (SELECT *, fired - lag(fired, 1, 0) OVER (PARTITION BY job_id ORDER BY k) AS now FROM r) r JOIN n USING (job_id, k)
    WHERE now = 1""",
    ),
)
def registry_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all actions that ran; the text is searched once."""
    jobs, turns, polls = _registry(spark, sf_dir)
    hits = materialise(registry_hits(jobs, turns), "registry-hits")
    done = registry_actions(jobs, hits, replay_registry(jobs, turns, polls, hits=hits))
    return done.select("job_id", "chunk_seq", "rule_name", "effect", "message")


ASKING_RULES = [LONG_RULES[0], LONG_RULES[1] | {"action": {"class_name": "NewJobAction", "job_config": "sweep"}}]


@query(
    "registry_requests",
    REGISTRY_SQL.replace(
        "SELECT job_id, arg_max(attempts, k) AS attempts, arg_max(outcome, k) AS final_state, CAST(max(fired) AS BIGINT) AS fired\nFROM r GROUP BY 1",
        """SELECT r.job_id, chunk_seq, 'progress' AS rule_name, 'Submitting local command job' AS message, 'sweep' AS job_config
    FROM (SELECT *, fired - lag(fired, 1, 0) OVER (PARTITION BY job_id ORDER BY k) AS now FROM r) r JOIN n USING (job_id, k)
    WHERE now = 1 AND rule_idx = 3""",
    ),
)
def registry_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs that a registry's log rules ask for."""
    jobs, turns, polls = _registry(spark, sf_dir, ASKING_RULES)
    hits = materialise(registry_hits(jobs, turns), "registry-hits")
    done = registry_actions(jobs, hits, replay_registry(jobs, turns, polls, hits=hits))
    return done.filter(F.col("job_config").isNotNull()).select("job_id", "chunk_seq", "rule_name", "message", "job_config")


@query(
    "registry_after",
    REGISTRY_SQL.replace(
        "SELECT job_id, arg_max(attempts, k) AS attempts, arg_max(outcome, k) AS final_state, CAST(max(fired) AS BIGINT) AS fired\nFROM r GROUP BY 1",
        """SELECT r.job_id, arg_max(attempts, k) AS attempts, arg_max(outcome, k) AS final_state,
      CASE WHEN max(r.job_id) IS NOT NULL THEN 'RUNNING' END AS last_status,
      make_timestamp(min(chunk_seq * 1000000) FILTER (outcome IS NOT NULL)) AS end_ts
    FROM r LEFT JOIN n USING (job_id, k) GROUP BY 1""",
    ),
)
def registry_after_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry holds when the replay is over."""
    jobs, turns, polls = _registry(spark, sf_dir)
    done = registry_after(jobs, replay_registry(jobs, turns, polls), polls)
    return done.select("job_id", "attempts", "final_state", "last_status", "end_ts")
