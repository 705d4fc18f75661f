"""Replay of a whole registry, each job by its own definition.

Jobs share definitions, so the distinct ones are compiled on the driver, a bounded batch at a time, and a row only carries
the number of its own. Text is searched once for a batch, and each distinct leaf condition is computed once.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.render import (
    event_id,
    event_variables,
    parse_template,
    render_column,
    with_job_defaults,
)
from tidewatch.operators import lifecycle as lc
from tidewatch.operators.actions import default_text, effect_of, normal_level
from tidewatch.operators.conditions import (
    Condition,
    FileContent,
    FileExists,
    GlobExists,
    Scope,
    attach_markers,
    uses,
)
from tidewatch.operators.fold import Kernel, ordered_fold
from tidewatch.operators.matching import match_registry_rules
from tidewatch.operators.transitions import match_state_rule_table
from tidewatch.session import materialise
from tidewatch.sources import registry
from tidewatch.sources.definitions import spec_from

STEERING = ("log_events", "state_events", "start_condition", "cancel_condition", "finish_condition")
# Definitions compiled at once; jobs of more are dealt to batches by a hash of their definition.
BATCH_DEFINITIONS = 2_000
FILES = (FileExists, FileContent, GlobExists)


class DefinitionsKernel(Kernel):
    """Hands each job's rows to the kernel of its definition."""

    outputs = lc.LifecycleKernel.outputs
    needs = (*lc.LifecycleKernel.needs, "spec_no", "first_attempts", "first_submitted", "first_memory")

    def __init__(self, specs: list[lc.Spec]) -> None:
        self.kernels = [lc.LifecycleKernel(spec) for spec in specs]

    def run(self, state: Any, cols: dict[str, Any], lo: int, hi: int, out: dict[str, list] | None) -> Any:
        kernel = self.kernels[int(cols["spec_no"][lo])]
        if state is None:
            state = kernel.spec.fresh() | {"a": int(cols["first_attempts"][lo]), "s": bool(cols["first_submitted"][lo])}
            if cols["first_memory"][lo]:
                state["m"] = lc.remembered(kernel.spec, **json.loads(cols["first_memory"][lo]))
        return kernel.run(state, cols, lo, hi, out)

    def reduce(self, state: Any, first: dict[str, Any]) -> tuple[Any, Any]:
        return self.kernels[int(first["spec_no"])].reduce(state, first)

    def restore(self, state: Any, rest: Any) -> Any:
        return self.kernels[0].restore(state, rest)

    def guess(self, entry: Any, other: Any, end: Any) -> Any:
        # A guess may be off by the attempts a definition starts with; it is folded again then.
        return self.kernels[0].guess(entry, other, end)


def number_definitions(jobs: DataFrame) -> tuple[DataFrame, list[lc.Spec]]:
    """``jobs`` with ``spec_no``, and the definitions by that number."""
    body = F.to_json(F.struct(*STEERING))
    tagged = jobs.withColumn("__body", F.coalesce(body, F.lit("{}"))).withColumn("__hash", F.sha2("__body", 256))
    distinct = tagged.groupBy("__hash").agg(F.any_value("__body").alias("body")).collect()
    bodies = sorted((row["__hash"], row["body"]) for row in distinct)
    numbers = jobs.sparkSession.createDataFrame([(h, i) for i, (h, _) in enumerate(bodies)], "__hash string, spec_no int")
    # At most a batch of hashes.
    numbered = tagged.join(F.broadcast(numbers), "__hash").drop("__body", "__hash")
    return numbered, [spec_from(body) for _, body in bodies]


def _batches(jobs: DataFrame) -> int:
    """Batches that hold at most BATCH_DEFINITIONS definitions each, but for the chance of an uneven hash."""
    definitions = jobs.select(F.xxhash64(F.to_json(F.struct(*STEERING)))).distinct().count()
    return 1 if definitions <= BATCH_DEFINITIONS else -(-2 * definitions // BATCH_DEFINITIONS)


def _leaf_results(rows: DataFrame, specs: list[lc.Spec], scope: Scope, markers: DataFrame | None) -> DataFrame:
    """Add ``held``: the numbers of the leaves of each row's gate that hold."""
    uses_of: dict[str, tuple[Condition, dict[tuple[str, int], list[int]]]] = {}
    for no, spec in enumerate(specs):
        for key, gate in spec.gates.items():
            offset = lc.LABEL_STEP * lc.LABELS.index(key) if key in lc.LABELS else 0
            for i, leaf in enumerate(gate.leaves):
                _, places = uses_of.setdefault(repr(leaf), (leaf, {}))
                places.setdefault((key, offset + i), []).append(no)
    columns = rows.columns
    tests = []
    for leaf, places in uses_of.values():
        flags = {}
        if uses(leaf, *FILES):
            if markers is None:
                raise ValueError("these definitions need a table of markers")
            rows, flags = attach_markers(rows, leaf, markers, scope.variables, "ts")
            result = f"__leaf_{len(rows.columns)}"
            passed = leaf.compile(Scope(scope.ts, metadata=scope.metadata, variables=scope.variables, marker=flags))[0]
            rows = rows.withColumn(result, passed).drop(*[c for c in rows.columns if c.startswith("__marker_")])
            passed = F.col(result)
        else:
            passed = leaf.compile(scope)[0]
        for (key, number), specs_with in places.items():
            if key in lc.LABELS:
                here = F.col("kind") == lc.DECISION
            else:
                kind, rule = (int(x) for x in key.split(":"))
                here = (F.col("kind") == kind) & (F.col("rule_idx") == rule)
            tests.append((number, here & F.col("spec_no").isin(specs_with) & passed))
    return rows.select(*columns, lc.numbers_of(tests).alias("held"))


def registry_hits(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits of every job's own log rules, with their payload. Write them to use them in more than one place."""
    rules = registry.log_rules(jobs).select(
        "job_id", "rule_idx", "name", "pattern", "pattern_type", "match_once", "metadata", "extract_groups"
    )
    return match_registry_rules(chunks, rules, payload=True)


def registry_actions(jobs: DataFrame, hits: DataFrame, replayed: DataFrame) -> DataFrame:
    """What fired log rules do: effect, level, rendered message and the job they ask for, if any.

    One row per firing: (job_id, chunk_seq, rule_idx, match_seq, ts, rule_name, action, effect, level, message, job_config).
    """
    place = ["job_id", "chunk_seq", "rule_idx", "match_seq"]
    fired = replayed.filter((F.col("kind") == lc.LOG_TRIGGER) & F.col("fired")).select(*place, "attempts")
    does = registry.log_rules(jobs).select("job_id", "rule_idx", F.col("action").alias("does"))
    empty = F.create_map().cast("map<string,string>")
    about = jobs.select(
        "job_id",
        with_job_defaults(
            F.coalesce("metadata", empty), F.col("job_id"), F.col("name"), F.coalesce("class_name", F.lit(""))
        ).alias("job_metadata"),
        F.create_map(F.lit("job_id"), F.col("job_id").cast("string"), F.lit("job_name"), F.col("name")).alias("event_md"),
    )
    rows = hits.withColumn("chunk_seq", F.coalesce(F.col("chunk_seq").cast("long"), F.lit(0)))
    rows = rows.join(fired, place).join(does, ["job_id", "rule_idx"]).join(about, "job_id")
    made_id = event_id(F.col("job_id"), F.col("rule_name"), F.col("ts"), F.element_at("payload", "checkpoint_iteration"))
    seen = event_variables(F.col("job_metadata"), F.col("event_md"), F.col("payload"), made_id, F.col("rule_name"), F.col("attempts"))
    kind = F.col("does.class_name")
    given = F.when(kind == "LogAction", F.col("does.message")).when(kind != "NewJobAction", F.col("does.reason"))
    text = F.coalesce(given, default_text(kind))
    return rows.select(
        *place,
        "ts",
        "rule_name",
        kind.alias("action"),
        effect_of(kind).alias("effect"),
        normal_level(F.coalesce("does.level", F.lit("info"))).alias("level"),
        F.when(kind == "LogAction", render_column(text, seen)).otherwise(text).alias("message"),
        F.when(kind == "NewJobAction", F.col("does.job_config")).alias("job_config"),
    )


def registry_after(jobs: DataFrame, replayed: DataFrame, polls: DataFrame) -> DataFrame:
    """The registry after the replay: attempts, last_status, final_state and end_ts of every job."""
    ended = F.col("outcome").isNotNull()
    done = replayed.groupBy("job_id").agg(
        F.max("attempts").alias("__attempts"), F.max("outcome").alias("__state"), F.min(F.when(ended, F.col("ts"))).alias("__end")
    )
    status = polls.groupBy("job_id").agg(F.max_by("status", F.struct("chunk_seq", "ts")).alias("__status"))

    def kept(name: str, kind: str):
        return F.col(name) if name in jobs.columns else F.lit(None).cast(kind)

    return (
        jobs.join(done, "job_id", "left")
        .join(status, "job_id", "left")
        .withColumns(
            {
                "attempts": F.coalesce("__attempts", "attempts"),
                "last_status": F.coalesce(F.col("__status"), kept("last_status", "string")),
                "final_state": F.coalesce(kept("final_state", "string"), F.col("__state")),
                "end_ts": F.coalesce(kept("end_ts", "timestamp_ntz"), F.col("__end")),
            }
        )
        .drop("__attempts", "__state", "__end", "__status")
    )


def _shaped(rows: DataFrame, kind: int, flag: Column, rule: str | None = None) -> DataFrame:
    seq = F.col("match_seq") if "match_seq" in rows.columns else F.lit(0)
    return rows.select(
        "job_id",
        F.coalesce(F.col("chunk_seq").cast("long"), F.lit(0)).alias("chunk_seq"),
        F.lit(kind).alias("kind"),
        F.coalesce(F.col(rule) if rule else F.lit(0), F.lit(0)).alias("rule_idx"),
        F.coalesce(seq.cast("int"), F.lit(0)).alias("match_seq"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        flag.alias("flag"),
        (F.col("rule_name") if "rule_name" in rows.columns else F.lit(None).cast("string")).alias("event_name"),
        (F.col("payload") if "payload" in rows.columns else F.lit(None).cast("map<string,string>")).alias("payload"),
    )


def replay_registry(
    jobs: DataFrame,
    chunks: DataFrame,
    polls: DataFrame,
    markers: DataFrame | None = None,
    changes: DataFrame | None = None,
    partitions: int | None = None,
    hits: DataFrame | None = None,
) -> DataFrame:
    """Decisions of every job's polls by its own rules and conditions.

    ``jobs`` is the flat registry, ``chunks(job_id, chunk_seq, ts, text)`` the log text,
    ``polls(job_id, chunk_seq, ts, status, submit_ok)`` the statuses seen, and ``changes(job_id, chunk_seq, ts,
    old_status, new_status)`` the status changes for state rules. Cooldowns, timeouts and latches go on from what the
    records remember (``action_state``, ``condition_state``). Beyond BATCH_DEFINITIONS distinct definitions the jobs
    are replayed batch by batch, each with its own rows only. ``hits`` may be given as written from ``registry_hits``.
    """
    batches = _batches(jobs)
    if batches == 1:
        return _replay_batch(jobs, chunks, polls, markers, changes, partitions, hits)
    # Text is searched once, whatever the number of batches.
    hits = materialise(registry_hits(jobs, chunks), "registry-hits") if hits is None else hits
    dealt = jobs.withColumn("__batch", F.pmod(F.xxhash64(F.to_json(F.struct(*STEERING))), F.lit(batches)))
    done = []
    for batch in range(batches):
        mine = materialise(dealt.filter(F.col("__batch") == batch).drop("__batch"), "registry-batch")
        rest = [None if t is None else t.join(mine.select("job_id"), "job_id", "left_semi") for t in (chunks, polls, changes, hits)]
        done.append(_replay_batch(mine, rest[0], rest[1], markers, rest[2], partitions, rest[3]))
    return reduce(DataFrame.unionByName, done)


def _replay_batch(
    jobs: DataFrame,
    chunks: DataFrame,
    polls: DataFrame,
    markers: DataFrame | None,
    changes: DataFrame | None,
    partitions: int | None,
    hits: DataFrame | None,
) -> DataFrame:
    numbered, specs = number_definitions(jobs)
    yes = F.lit(True)
    submits = polls.groupBy("job_id", "chunk_seq").agg(F.bool_and("submit_ok").alias("submit_ok"))
    hits = (registry_hits(jobs, chunks) if hits is None else hits).join(submits, ["job_id", "chunk_seq"], "left")
    parts = [
        _shaped(hits, lc.LOG_TRIGGER, F.coalesce("submit_ok", yes), "rule_idx"),
        _shaped(polls, lc.DECISION, F.coalesce("submit_ok", yes)),
        _shaped(polls, lc.NATURAL_END, F.coalesce(F.col("status").isin(*lc.TERMINAL), F.lit(False))),
    ]
    if changes is not None:
        hits = match_state_rule_table(changes, registry.state_rules(jobs))
        parts.append(_shaped(hits, lc.STATE_TRIGGER, yes, "rule_idx"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    class_name = F.coalesce("class_name", F.lit(""))
    empty = F.create_map().cast("map<string,string>")
    about = numbered.select(
        "job_id",
        "spec_no",
        F.coalesce("attempts", F.lit(1)).alias("first_attempts"),
        F.coalesce("submitted", F.lit(True)).alias("first_submitted"),
        _memory(numbered).alias("first_memory"),
        with_job_defaults(F.coalesce("metadata", empty), F.col("job_id"), F.col("name"), class_name).alias("job_metadata"),
        F.create_map(F.lit("job_id"), F.col("job_id").cast("string"), F.lit("job_name"), F.col("name")).alias("event_md"),
    )
    keys = sorted({k for spec in specs for gate in spec.gates.values() for leaf in gate.leaves for k in _template_keys(leaf)})
    # What a rule's templates see; a job's own conditions see its metadata only. Only names that templates use are kept.
    made_id = event_id(F.col("job_id"), F.col("event_name"), F.col("ts"), F.element_at("payload", "checkpoint_iteration"))
    of_event = event_variables(F.col("job_metadata"), F.col("event_md"), F.coalesce("payload", empty), made_id, F.col("event_name"))
    seen = F.when(F.col("kind") == lc.DECISION, F.col("job_metadata")).otherwise(of_event)
    seen = F.map_filter(seen, lambda k, _: k.isin(*keys)) if keys else empty
    # Written before the leaves are computed: marker leaves read the rows more than once, the text only once.
    rows = rows.join(about, "job_id").withColumns({"spec_no": F.coalesce("spec_no", F.lit(0)), "seen": seen})
    rows = materialise(rows.drop("job_metadata", "payload", "event_name"), "registry-rows")
    scope = Scope(ts=F.col("ts"), metadata=F.col("event_md"), variables=F.col("seen"))
    us = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0))
    ready = _leaf_results(rows, specs, scope, markers).withColumn("us", us).drop("seen", "event_md")
    if any(uses(leaf, *FILES) for spec in specs for gate in spec.gates.values() for leaf in gate.leaves):
        ready = materialise(ready, "registry-leaves")
    return ordered_fold(ready, "job_id", lc.REPLAY_ORDER, DefinitionsKernel(specs), partitions)


def _memory(jobs: DataFrame) -> Column:
    """The states a record holds, as one JSON text; NULL where it holds none."""
    parts = [F.col(c) if c in jobs.columns else F.lit(None).cast("string") for c in ("action_state", "condition_state")]
    actions, conditions = (F.coalesce(F.when(p.isin("", "null"), None).otherwise(p), F.lit("{}")) for p in parts)
    both = F.concat(F.lit('{"actions":'), actions, F.lit(',"conditions":'), conditions, F.lit("}"))
    return F.when((actions != "{}") | (conditions != "{}"), both)


def _template_keys(leaf: Condition) -> list[str]:
    text = getattr(leaf, "path", "") if not isinstance(leaf, GlobExists) else leaf.pattern
    return [name for kind, name in parse_template(text or "") if kind == "key"]
