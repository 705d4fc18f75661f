"""Status feeds: merging, attaching, changes of status and the rules on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import DEFAULT_LIMIT, last_known, previous
from tidewatch.operators.rules import StateRule, active


def latest_status(snapshots: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Current status of each runtime id."""
    return snapshots.groupBy("runtime_job_id").agg(F.max_by("status", F.struct(*order)).alias("status"))


def merge_status(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two backends' statuses in one; the second wins on an id both know, even with a NULL status."""
    both = first.select("runtime_job_id", "status", F.lit(1).alias("rank")).unionByName(
        second.select("runtime_job_id", "status", F.lit(2).alias("rank"))
    )
    return both.groupBy("runtime_job_id").agg(F.max_by("status", "rank").alias("status"))


def attach_status(jobs: DataFrame, status: DataFrame) -> DataFrame:
    """Add the current status to each job; NULL when its runtime id is not reported."""
    known = status.filter(F.col("runtime_job_id").isNotNull()).select("runtime_job_id", "status")
    return jobs.join(known, "runtime_job_id", "left")


def status_changes(
    snapshots: DataFrame, key: str = "runtime_job_id", order: Sequence[str] = ("ts",), limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Rows whose status differs from the key's previous one; before the first row the status is NULL."""
    seen = previous(snapshots, [key], list(order), {"status": "old_status"}, limit)
    changed = ~F.col("old_status").eqNullSafe(F.col("status"))
    spelled = F.concat(
        F.coalesce("old_status", F.lit("None")), F.lit(" -> "), F.coalesce("new_status", F.lit("None"))
    )
    return (
        seen.filter(changed)
        .withColumnRenamed("status", "new_status")
        .drop("has_previous")
        .withColumn("transition", spelled)
    )


def status_changes_with_missing(
    snapshots: DataFrame, polls: DataFrame, key: str = "runtime_job_id", limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Changes of status where a key that a poll does not report has NULL status at that poll.

    ``snapshots`` holds one row per key and poll time, ``polls(ts)`` all poll times. The rows that are missing are
    never made: a key was missing when its previous snapshot is older than the previous poll.
    """
    times = polls.select("ts").distinct().withColumn("__all", F.lit(0))
    before = previous(times, ["__all"], ["ts"], {"ts": "prev_poll"}, limit).select("ts", "prev_poll")
    after = before.select(F.col("prev_poll").alias("ts"), F.col("ts").alias("next_poll"))
    around = before.join(after, "ts", "left")
    reported = snapshots.filter(F.col("status").isNotNull()).select(key, "ts", "status").join(around, "ts")
    seen = previous(
        reported, [key], ["ts"], {"status": "old", "ts": "old_ts", "next_poll": "gone_at"}, limit
    )
    absent = F.col("has_previous") & (F.col("old_ts") < F.col("prev_poll"))
    none = F.lit(None).cast("string")

    def change(ts, old, new):
        return F.struct(ts.alias("ts"), old.alias("old_status"), new.alias("new_status"))

    back = change(F.col("ts"), none, F.col("status"))
    gone = change(F.col("gone_at"), F.col("old"), none)
    direct = change(F.col("ts"), F.col("old"), F.col("status"))
    found = (
        F.when(absent, F.array(gone, back))
        .when(~F.col("old").eqNullSafe(F.col("status")), F.array(direct))
        .otherwise(F.array())
    )
    inner = seen.select(key, F.explode(found).alias("c")).select(key, "c.*")
    last = reported.groupBy(key).agg(F.max_by(F.struct("status", "next_poll"), F.col("ts")).alias("l"))
    ended = last.filter(F.col("l.next_poll").isNotNull()).select(
        key, F.col("l.next_poll").alias("ts"), F.col("l.status").alias("old_status"), none.alias("new_status")
    )
    spelled = F.concat(
        F.coalesce("old_status", F.lit("None")), F.lit(" -> "), F.coalesce("new_status", F.lit("None"))
    )
    return inner.unionByName(ended).withColumn("transition", spelled)


def match_state_rules(changes: DataFrame, rules: Sequence[StateRule]) -> DataFrame:
    """One row per change and matching rule. The rules are literals, so this is a map-only step."""
    hits = []
    for idx, rule in active(list(rules)):
        fits = F.lit(True)
        if rule.old is not None:
            fits = fits & F.col("old_status").eqNullSafe(F.lit(rule.old))
        if rule.new is not None:
            fits = fits & F.col("new_status").eqNullSafe(F.lit(rule.new))
        hit = F.struct(F.lit(idx).alias("rule_idx"), F.lit(rule.name).alias("rule_name"))
        hits.append(F.when(fits, hit))
    if not hits:
        return changes.withColumns({"rule_idx": F.lit(0), "rule_name": F.lit("")}).limit(0)
    fired = F.explode(F.array_compact(F.array(*hits)))
    return changes.withColumn("__hit", fired).select(*changes.columns, "__hit.*")


def match_state_rule_table(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes against ``rules(job_id, rule_idx, name, old, new)`` of the same job."""
    side = rules.select("job_id", "rule_idx", F.col("name").alias("rule_name"), "old", "new")
    fits = (F.col("old").isNull() | (F.col("old") == F.col("old_status"))) & (
        F.col("new").isNull() | (F.col("new") == F.col("new_status"))
    )
    return changes.join(side, "job_id").filter(F.coalesce(fits, F.lit(False))).drop("old", "new")


def status_at_chunk(
    chunks: DataFrame, snapshots: DataFrame, order: Sequence[str] = ("seq",), limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Status each log chunk saw: the latest snapshot of its job at or before the chunk's time.

    Both feeds are put on one time line; a snapshot comes before a chunk of the same instant.
    """
    tie = list(order)
    line = chunks.select(
        "job_id", "ts", F.lit(1).alias("kind"), *tie, F.lit(None).cast("struct<status:string>").alias("seen")
    ).unionByName(
        snapshots.select("job_id", "ts", F.lit(0).alias("kind"), *tie, F.struct("status").alias("seen"))
    )
    known = last_known(line, ["job_id"], ["ts", "kind", *tie], F.col("seen"), "known", limit)
    return known.filter(F.col("kind") == 1).select("job_id", "ts", *tie, F.col("known.status").alias("status"))


def inactivity_gaps(
    chunks: DataFrame,
    gap_seconds: float,
    key: str = "job_id",
    order: Sequence[str] = ("ts",),
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Silences of more than ``gap_seconds`` between one chunk of a job and the next."""
    seen = previous(chunks.select(key, *order), [key], list(order), {order[0]: "silent_from"}, limit)
    micros = F.unix_micros(F.col(order[0]).cast("timestamp")) - F.unix_micros(
        F.col("silent_from").cast("timestamp")
    )
    return (
        seen.withColumn("gap_us", micros)
        .filter(F.col("gap_us") > F.lit(int(gap_seconds * 1_000_000)))
        .withColumnRenamed(order[0], "silent_until")
        .drop("has_previous")
    )


def open_gaps(chunks: DataFrame, gap_seconds: float, now, key: str = "job_id", ts: str = "ts") -> DataFrame:
    """Jobs silent for more than ``gap_seconds`` at ``now``."""
    last = chunks.groupBy(key).agg(F.max(ts).alias("silent_from"))
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("silent_from").cast("timestamp"))
    return last.withColumn("gap_us", micros).filter(F.col("gap_us") > F.lit(int(gap_seconds * 1_000_000)))
