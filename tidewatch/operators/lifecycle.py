"""Job lifecycle: gates, effects, attempts and outcomes over ordered triggers.

``step`` is the exact rule book, one row at a time; the batch fold and the stream both call it. Rule sets without
remembered state need no fold and are answered by aggregates and short windows (:func:`plan_kind`).
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.actions import OUTCOMES, per_rule
from tidewatch.operators.conditions import (
    Composite,
    Condition,
    Cooldown,
    MaxAttempts,
    Not,
    Scope,
    Timeout,
    uses,
)
from tidewatch.operators.fold import Kernel, ordered_fold
from tidewatch.operators.ordered import DEFAULT_LIMIT, running_sum
from tidewatch.operators.rules import active
from tidewatch.session import materialise

# Statuses that end a job, and the kinds of rows in one poll in the order they are looked at.
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
STATE_TRIGGER, DECISION, LOG_TRIGGER, NATURAL_END = 0, 1, 2, 3
LONG_AGO = -(2**62)
LABELS = ("start", "cancel", "finish")
# Leaves of the three job conditions are numbered this far apart, so that one list holds the results of all.
LABEL_STEP = 1 << 24
STATEFUL = (MaxAttempts, Cooldown, Timeout)


@dataclass(frozen=True)
class Gate:
    """A condition tree cut into remembered parts and leaves computed as columns."""

    tree: tuple | None
    leaves: tuple[Condition, ...] = ()
    persistent_pass: bool = False
    persistent_fail: bool = False

    def longest(self, kind: str) -> int | None:
        """Largest limit of that kind in the tree."""
        limits: list[int] = []

        def visit(node) -> None:
            if node[0] == kind:
                limits.append(node[1])
            elif node[0] in ("all", "any"):
                for child in node[1]:
                    visit(child)
            elif node[0] == "not":
                visit(node[1])

        if self.tree is not None:
            visit(self.tree)
        return max(limits, default=None)


def compile_gate(condition: Condition | None, offset: int = 0) -> Gate:
    if condition is None:
        return Gate(None)
    leaves: list[Condition] = []

    def build(node: Condition) -> tuple:
        if isinstance(node, MaxAttempts):
            return ("attempts", node.max_attempts)
        if isinstance(node, Cooldown):
            return ("cooldown", round(node.cooldown_seconds * 1_000_000))
        if isinstance(node, Timeout):
            return ("timeout", round(node.timeout_seconds * 1_000_000))
        if isinstance(node, Composite):
            return (node.mode, tuple(build(child) for child in node.conditions))
        if isinstance(node, Not):
            return ("not", build(node.condition))
        leaves.append(node)
        return ("leaf", offset + len(leaves) - 1)

    tree = build(condition)
    return Gate(tree, tuple(leaves), condition.persistent_pass, condition.persistent_fail)


@dataclass(frozen=True)
class Spec:
    """All that steers a job: its log and state rules and its three own conditions."""

    log_rules: Sequence[Any] = ()
    state_rules: Sequence[Any] = ()
    start: Condition | None = None
    cancel: Condition | None = None
    finish: Condition | None = None
    submitted: bool = True
    attempts: int = 1
    gates: Mapping[str, Gate] = field(init=False)
    effects: Mapping[str, str] = field(init=False)

    def __post_init__(self) -> None:
        gates: dict[str, Gate] = {}
        effects: dict[str, str] = {}
        for kind, rules in ((LOG_TRIGGER, self.log_rules), (STATE_TRIGGER, self.state_rules)):
            for idx, rule in active(list(rules)):
                name = f"{kind}:{idx}"
                gates[name] = compile_gate(rule.condition)
                # State rules never steer the lifecycle.
                effects[name] = rule.action.effect if kind == LOG_TRIGGER else "noop"
        for place, label in enumerate(LABELS):
            gates[label] = compile_gate(getattr(self, label), LABEL_STEP * place)
        object.__setattr__(self, "gates", gates)
        object.__setattr__(self, "effects", effects)

    def fresh(self) -> dict[str, Any]:
        return {"a": self.attempts, "s": self.submitted, "o": None, "c": None, "m": {}}


def remembered(spec: Spec, actions: Mapping[str, Any], conditions: Mapping[str, Any]) -> dict[str, list]:
    """What a record's ``action_state`` and ``condition_state`` say: first evaluation, last firing and latch by gate.

    Times in records are seconds since 1970.
    """

    def micros(seconds: Any) -> int | None:
        return None if seconds is None else round(float(seconds) * 1_000_000)

    memory = {}
    for key in spec.gates:
        last, about = None, conditions.get(key)
        if key not in LABELS:
            kind, idx = (int(x) for x in key.split(":"))
            source, rules = ("log", spec.log_rules) if kind == LOG_TRIGGER else ("state", spec.state_rules)
            held = actions.get(f"{source}:{rules[idx].name}:{idx}") or {}
            last, about = micros(held.get("last_action_ts")), held.get("condition")
        about = about or {}
        latch = True if about.get("latched_pass") else False if about.get("latched_fail") else None
        found = [micros(about.get("started_ts")), last, latch]
        if found != [None, None, None]:
            memory[key] = found
    return memory


def _holds(node: tuple, held: Collection[int], attempts: int, now: int, memory: list) -> bool:
    kind, arg = node
    if kind == "leaf":
        return arg in held
    if kind == "attempts":
        return attempts < arg
    if kind == "cooldown":
        return memory[1] is None or now - memory[1] >= arg
    if kind == "timeout":
        return now - memory[0] < arg
    if kind == "not":
        return not _holds(arg, held, attempts, now, memory)
    # Children only read, so stopping early changes nothing.
    test = all if kind == "all" else any
    return test(_holds(child, held, attempts, now, memory) for child in arg)


def _passes(gate: Gate, key: str, state: dict[str, Any], held: Collection[int], now: int) -> bool:
    """Evaluate a gate and remember its first evaluation and its latch."""
    memory = list(state["m"].get(key) or (None, None, None))
    if memory[0] is None:
        memory[0] = now
    passed = _holds(gate.tree, held, state["a"], now, memory)
    if memory[2] is not None:
        passed = memory[2]
    elif passed and gate.persistent_pass or not passed and gate.persistent_fail:
        memory[2] = passed
    state["m"][key] = memory
    return passed


def step(
    spec: Spec, state: dict[str, Any], chunk: int, kind: int, rule: int, now: int, held: Collection[int], flag: bool
) -> tuple[bool, bool]:
    """Apply one row to ``state`` in place; returns (evaluated, fired).

    ``held`` are the numbers of the leaves that hold. ``flag`` tells of a
    decision or trigger row whether a submission would succeed then, of an end row whether the status is terminal.
    """
    if state["o"] is not None:
        return False, False
    if kind == DECISION:
        return True, _decide(spec, state, chunk, now, held, flag)
    if kind != STATE_TRIGGER and (not state["s"] or state["c"] == chunk):
        return False, False
    if kind == NATURAL_END:
        if flag:
            state["o"] = "finished"
        return True, flag
    key = f"{kind}:{rule}"
    gate = spec.gates[key]
    if gate.tree is not None and not _passes(gate, key, state, held, now):
        return True, False
    memory = list(state["m"].get(key) or (None, None, None))
    memory[1] = now
    state["m"][key] = memory
    effect = spec.effects[key]
    if effect == "restart":
        # A restart that can't be submitted leaves the job waiting for its start.
        state["a"] += 1
        state["c"] = chunk
        state["s"] = flag
    elif effect != "noop":
        state["o"] = OUTCOMES[effect]
    return True, True


def _decide(spec: Spec, state: dict[str, Any], chunk: int, now: int, held: Collection[int], submit_ok: bool) -> bool:
    for label, outcome in (("cancel", "cancelled"), ("finish", "finished")):
        gate = spec.gates[label]
        if gate.tree is not None and _passes(gate, label, state, held, now):
            state["o"] = outcome
            return True
    if state["s"]:
        return False
    state["c"] = chunk
    gate = spec.gates["start"]
    if gate.tree is not None and not _passes(gate, "start", state, held, now):
        return False
    state["a"] += 1
    state["s"] = submit_ok
    return True


class LifecycleKernel(Kernel):
    needs = ("chunk_seq", "kind", "rule_idx", "us", "held", "flag")
    outputs = T.StructType(
        [
            T.StructField("evaluated", T.BooleanType()),
            T.StructField("fired", T.BooleanType()),
            T.StructField("attempts", T.IntegerType()),
            T.StructField("outcome", T.StringType()),
        ]
    )

    def __init__(self, spec: Spec) -> None:
        self.spec = spec
        limits = [gate.longest("attempts") for gate in spec.gates.values()]
        self.attempt_limit = max((n for n in limits if n is not None), default=None)
        self.limits = {
            key: (gate.longest("timeout"), gate.longest("cooldown")) for key, gate in spec.gates.items()
        }

    def run(self, state: Any, cols: dict[str, Any], lo: int, hi: int, out: dict[str, list] | None) -> Any:
        state = self.spec.fresh() if state is None else {**state, "m": dict(state["m"])}
        chunk, kind, rule = cols["chunk_seq"], cols["kind"], cols["rule_idx"]
        us, held, flag = cols["us"], cols["held"], cols["flag"]
        for i in range(lo, hi):
            seen, fired = step(
                self.spec, state, int(chunk[i]), int(kind[i]), int(rule[i]), int(us[i]), held[i] or (), bool(flag[i])
            )
            if out is not None:
                out["evaluated"].append(seen)
                out["fired"].append(fired)
                out["attempts"].append(state["a"])
                out["outcome"].append(state["o"])
        return state

    def reduce(self, state: Any, first: dict[str, Any]) -> tuple[Any, Any]:
        if state is None:
            return None, None
        if state["o"] is not None:
            return {"a": 0, "s": True, "o": state["o"], "c": None, "m": {}}, {"whole": state}
        now = int(first["us"])
        kept = 1 if self.attempt_limit is None else min(state["a"], self.attempt_limit)
        memories = {}
        for key, (started, last, latch) in state["m"].items():
            timeout, cooldown = self.limits[key]
            if timeout is None:
                started = None if started is None else LONG_AGO
            elif started is not None and now - started >= timeout:
                started = LONG_AGO
            if last is not None and (cooldown is None or now - last >= cooldown):
                last = None
            memories[key] = [started, last, latch]
        chunk = state["c"] if state["c"] == first["chunk_seq"] else None
        core = {"a": kept, "s": state["s"], "o": None, "c": chunk, "m": memories}
        return core, {"more": state["a"] - kept}

    def restore(self, state: Any, rest: Any) -> Any:
        if rest is None:
            return state
        if "whole" in rest:
            return rest["whole"]
        return {**state, "a": state["a"] + rest["more"]}

    def guess(self, entry: Any, other: Any, end: Any) -> Any:
        """Earlier starts, latches and outcomes stay; attempts add up; the last firing is the newer one."""
        if entry is None or entry["o"] is not None:
            return end if entry is None else entry
        before = self.spec.fresh() if other is None else other
        memories = {}
        for key in {**entry["m"], **end["m"]}:
            mine, theirs = (side["m"].get(key) or (None, None, None) for side in (entry, end))
            memories[key] = [_first(mine[0], theirs[0]), _first(theirs[1], mine[1]), _first(mine[2], theirs[2])]
        return {
            "a": entry["a"] + end["a"] - before["a"],
            "s": entry["s"] or end["s"],
            "o": end["o"],
            "c": end["c"],
            "m": memories,
        }


# What a job takes from one run to the next: see ``end_states``.
END_STATES = T.StructType(
    [
        T.StructField("attempts", T.IntegerType()),
        T.StructField("submitted", T.BooleanType()),
        T.StructField("outcome", T.StringType()),
        T.StructField(
            "memory",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("gate", T.StringType()),
                        T.StructField("started", T.LongType()),
                        T.StructField("last", T.LongType()),
                        T.StructField("latch", T.BooleanType()),
                    ]
                )
            ),
        ),
    ]
)


class ResumedKernel(LifecycleKernel):
    """Jobs begin where ``first_state``, a JSON text of END_STATES, says; without one they begin afresh."""

    needs = (*LifecycleKernel.needs, "first_state")

    def run(self, state: Any, cols: dict[str, Any], lo: int, hi: int, out: dict[str, list] | None) -> Any:
        if state is None and cols["first_state"][lo]:
            held = json.loads(cols["first_state"][lo])
            memory = {m["gate"]: [m.get("started"), m.get("last"), m.get("latch")] for m in held.get("memory", [])}
            state = {"a": held["attempts"], "s": held["submitted"], "o": held.get("outcome"), "c": None, "m": memory}
        return super().run(state, cols, lo, hi, out)


def _first(*values: Any) -> Any:
    return next((value for value in values if value is not None), None)


def end_states(replayed: DataFrame, spec: Spec, earlier: DataFrame | None = None) -> DataFrame:
    """Where each job stands after a replay: job_id and END_STATES, to start a later replay or a stream from.

    ``replayed`` are evaluated rows, as from ``replay``; ``earlier`` the states that replay started from. Aggregates only: a gate
    was first evaluated at its first evaluated row and last fired at its last fired one, and a latch follows from which
    evaluations passed. A job without evaluated rows has its earlier state or none. The next run has to begin with a
    new chunk of the job. A latch of a start condition can't be told from rows and is refused.
    """
    start = spec.gates["start"]
    if start.persistent_pass or start.persistent_fail:
        raise ValueError("a latched start condition leaves no trace in the rows")
    rows = replayed.filter("evaluated")
    place = F.struct(*REPLAY_ORDER)
    restarts = [int(key.split(":")[1]) for key, effect in spec.effects.items() if effect == "restart"]
    restarted = (F.col("kind") == LOG_TRIGGER) & F.col("rule_idx").isin(restarts) & F.col("fired")
    decided = F.col("kind") == DECISION
    submits = restarted | decided & F.col("fired") & F.col("outcome").isNull()
    waits = F.min(F.when(restarted & ~F.col("flag"), place))
    jobs = rows.groupBy("job_id").agg(
        F.max("attempts").alias("attempts"),
        F.max_by(F.when(submits, F.col("flag")), F.when(submits, place)).alias("submitted"),
        F.max("outcome").alias("outcome"),
        waits.alias("waits"),
    )
    memory = [
        _gate_memory(rows.filter((F.col("kind") == int(key.split(":")[0])) & (F.col("rule_idx") == int(key.split(":")[1]))), key, gate, place)
        for key, gate in spec.gates.items()
        if key not in LABELS and gate.tree is not None
    ]
    asked = rows.filter(decided)
    memory += [_gate_memory(asked.withColumn("fired", F.lit(False)), key, spec.gates[key], place) for key in ("cancel", "finish") if spec.gates[key].tree is not None]
    if start.tree is not None:
        late = F.lit(True) if not spec.submitted else F.col("waits").isNotNull() & (place > F.col("waits"))
        memory.append(_gate_memory(asked.join(jobs.select("job_id", "waits"), "job_id").filter(late).withColumn("fired", F.lit(False)), "start", start, place))
    jobs = jobs.drop("waits").withColumn("run", F.lit(1))
    shape = END_STATES["memory"].dataType.elementType
    gates = replayed.sparkSession.createDataFrame([], T.StructType([T.StructField("job_id", replayed.schema["job_id"].dataType), *shape, T.StructField("run", T.IntegerType())]))
    for part in memory:
        gates = gates.unionByName(part.withColumn("run", F.lit(1)))
    if earlier is not None:
        jobs = jobs.unionByName(earlier.select("job_id", "attempts", "submitted", "outcome", F.lit(0).alias("run")))
        gates = gates.unionByName(earlier.select("job_id", F.inline("memory")).withColumn("run", F.lit(0)))
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("run"))
    gates = gates.groupBy("job_id", "gate").agg(
        F.min_by("started", known("started")).alias("started"), F.max_by("last", known("last")).alias("last"), F.min_by("latch", known("latch")).alias("latch")
    )
    # As many as the definition has gates.
    held = gates.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(*shape.names))).alias("memory"))
    jobs = jobs.groupBy("job_id").agg(F.max("attempts").alias("attempts"), F.max_by("submitted", known("submitted")).alias("submitted"), F.max("outcome").alias("outcome"))
    return jobs.join(held, "job_id", "left").select(
        "job_id",
        F.col("attempts").cast("int").alias("attempts"),
        F.coalesce("submitted", F.lit(spec.submitted)).alias("submitted"),
        "outcome",
        F.coalesce("memory", F.array().cast(END_STATES["memory"].dataType)).alias("memory"),
    )


def _gate_memory(rows: DataFrame, key: str, gate: Gate, place: Column) -> DataFrame:
    """(job_id, gate, started, last, latch) of one gate from its evaluated rows; ``fired`` says that it passed."""
    if gate.persistent_pass and gate.persistent_fail:
        latch = F.min_by("fired", place)
    elif gate.persistent_pass:
        latch = F.when(F.bool_or("fired"), True)
    else:
        latch = F.when(~F.bool_and("fired"), False) if gate.persistent_fail else F.lit(None).cast("boolean")
    last = F.max_by(F.when(F.col("fired"), F.col("us")), F.when(F.col("fired"), place))
    # Times may go back along the rows; what counts is the first and the last of them.
    found = rows.groupBy("job_id").agg(F.min_by("us", place).alias("started"), last.alias("last"), latch.alias("latch"))
    return found.select("job_id", F.lit(key).alias("gate"), "started", "last", "latch")


def held_leaves(gate: Gate, scope: Scope, offset: int = 0) -> Column:
    """Numbers of the gate's leaves that hold."""
    return numbers_of([(offset + i, leaf.compile(scope)[0]) for i, leaf in enumerate(gate.leaves)])


def numbers_of(tests: Sequence[tuple[int, Column]]) -> Column:
    """The numbers whose test is true."""
    if not tests:
        return F.array().cast("array<int>")
    return F.array_compact(F.array(*[F.when(test, F.lit(number)) for number, test in tests]))


def trigger_rows(triggers: DataFrame, spec: Spec, scope: Scope | None = None, kind: int = LOG_TRIGGER) -> DataFrame:
    """Triggers in the shape the replay reads. ``scope`` is needed when gates have leaf conditions.

    A column ``submit_ok`` tells whether a restart would be submitted; without it all are.
    """
    scope = scope or Scope()
    rules = active(list(spec.log_rules if kind == LOG_TRIGGER else spec.state_rules))
    held = numbers_of([])
    if any(spec.gates[f"{kind}:{idx}"].leaves for idx, _ in rules):
        names = {id(rule): spec.gates[f"{kind}:{idx}"] for idx, rule in rules}
        held = per_rule(rules, F.col("rule_idx"), lambda rule: held_leaves(names[id(rule)], scope))
    seq = F.col("match_seq") if "match_seq" in triggers.columns else F.lit(0)
    return triggers.select(
        "job_id",
        F.coalesce(F.col("chunk_seq").cast("long"), F.lit(0)).alias("chunk_seq"),
        F.lit(kind).alias("kind"),
        F.coalesce(F.col("rule_idx"), F.lit(0)).alias("rule_idx"),
        F.coalesce(seq.cast("int"), F.lit(0)).alias("match_seq"),
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("us"),
        F.coalesce(held, numbers_of([])).alias("held"),
        (F.coalesce("submit_ok", F.lit(True)) if "submit_ok" in triggers.columns else F.lit(True)).alias("flag"),
    )


def poll_rows(polls: DataFrame, spec: Spec, scope: Scope | None = None) -> DataFrame:
    """A decision row and an end row per poll; ``polls(job_id, chunk_seq, ts, status, submit_ok)``."""
    scope = scope or Scope()
    held = F.concat(*[held_leaves(spec.gates[x], scope, LABEL_STEP * place) for place, x in enumerate(LABELS)])
    shaped = polls.select(
        "job_id",
        F.coalesce(F.col("chunk_seq").cast("long"), F.lit(0)).alias("chunk_seq"),
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("us"),
        held.alias("held"),
        F.coalesce(F.col("submit_ok"), F.lit(True)).alias("submit_ok"),
        F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)).alias("ended"),
    )
    both = F.explode(
        F.array(
            F.struct(F.lit(DECISION).alias("kind"), F.col("submit_ok").alias("flag")),
            F.struct(F.lit(NATURAL_END).alias("kind"), F.col("ended").alias("flag")),
        )
    )
    return shaped.withColumn("row", both).select(
        "job_id",
        "chunk_seq",
        "row.kind",
        F.lit(0).alias("rule_idx"),
        F.lit(0).alias("match_seq"),
        "us",
        "held",
        "row.flag",
    )


REPLAY_ORDER = ("chunk_seq", "kind", "rule_idx", "match_seq")


def replay_fold(rows: DataFrame, spec: Spec, partitions: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Exact replay: ``rows`` with evaluated, fired, attempts and outcome.

    ``initial``, as from ``end_states``, says where jobs stand before their first row.
    """
    if initial is None:
        return ordered_fold(rows, "job_id", REPLAY_ORDER, LifecycleKernel(spec), partitions)
    states = initial.select("job_id", F.to_json(F.struct(*END_STATES.names)).alias("first_state"))
    resumed = rows.join(states, "job_id", "left")
    return ordered_fold(resumed, "job_id", REPLAY_ORDER, ResumedKernel(spec), partitions).drop("first_state")


def plan_kind(spec: Spec) -> str:
    """``windows`` when no gate remembers anything, else ``fold``."""
    conditions = [r.condition for r in (*spec.log_rules, *spec.state_rules) if r.action is not None]
    conditions += [spec.start, spec.cancel, spec.finish]
    latches = any(c is not None and (c.persistent_pass or c.persistent_fail) for c in conditions)
    stateful = any(uses(c, *STATEFUL) for c in conditions)
    own = any(c is not None for c in (spec.start, spec.cancel, spec.finish)) or not spec.submitted
    return "fold" if latches or stateful or own else "windows"


def replay(rows: DataFrame, spec: Spec, partitions: int | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The evaluated rows, by the cheaper plan that is exact for ``spec`` and these rows.

    The rows are written first: both plans read them more than once, and they are a small part of the text. A restart
    that can't be submitted leaves a job waiting, which only the fold knows of.
    """
    rows = materialise(rows, "triggers")
    failing = rows.filter((F.col("kind") == LOG_TRIGGER) & ~F.col("flag"))
    if plan_kind(spec) == "windows" and ("restart" not in spec.effects.values() or failing.isEmpty()):
        return replay_windows(rows, spec, limit)
    return replay_fold(rows, spec, partitions).filter("evaluated")


def _stateless_pass(spec: Spec) -> Column:
    """Pass flag of a row from its leaves alone."""

    def expr(node: tuple) -> Column:
        kind, arg = node
        if kind == "leaf":
            return F.array_contains("held", arg)
        if kind == "not":
            return ~expr(arg)
        out = F.lit(kind == "all")
        for child in arg:
            out = out & expr(child) if kind == "all" else out | expr(child)
        return out

    passed = F.lit(True)
    for key, gate in spec.gates.items():
        if key not in LABELS and gate.tree is not None:
            kind, idx = (int(x) for x in key.split(":"))
            here = (F.col("kind") == kind) & (F.col("rule_idx") == idx)
            passed = F.when(here, expr(gate.tree)).otherwise(passed)
    return passed


def effect_column(spec: Spec) -> Column:
    expr = F.lit("noop")
    for key, effect in spec.effects.items():
        if effect != "noop":
            kind, idx = (int(x) for x in key.split(":"))
            expr = F.when((F.col("kind") == kind) & (F.col("rule_idx") == idx), effect).otherwise(expr)
    return expr


def chunk_stops(rows: DataFrame, effect: Column, passed: Column) -> DataFrame:
    """Place and effect of the first special effect of each chunk that has one."""
    place = F.struct("kind", "rule_idx", "match_seq")
    special = rows.filter((effect != "noop") & passed)
    return special.groupBy("job_id", "chunk_seq").agg(
        F.min(F.struct(place.alias("place"), effect.alias("effect"))).alias("stop")
    )


def chunk_effects(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Keep what is evaluated in each chunk: up to its first special effect, marked ``chunk_stop``."""
    place = F.struct("kind", "rule_idx", "match_seq")
    return (
        rows.join(stops, ["job_id", "chunk_seq"], "left")
        .filter(F.coalesce(place <= F.col("stop.place"), F.lit(True)))
        .select(*rows.columns, F.coalesce(place == F.col("stop.place"), F.lit(False)).alias("chunk_stop"))
    )


def job_ends(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Where each job that ends does so: its first finish or cancel, or an end row no other effect comes before."""
    forced = stops.filter(F.col("stop.effect").isin("finish", "cancel")).select(
        "job_id", F.struct("chunk_seq", "stop.place.*").alias("end")
    )
    natural = (
        rows.filter((F.col("kind") == NATURAL_END) & F.col("flag"))
        .join(stops, ["job_id", "chunk_seq"], "left_anti")
        .select("job_id", F.struct(*REPLAY_ORDER).alias("end"))
    )
    return forced.unionByName(natural).groupBy("job_id").agg(F.min("end").alias("end"))


def close_jobs(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Drop what comes after the end of a job."""
    within = F.coalesce(F.struct(*REPLAY_ORDER) <= F.col("end"), F.lit(True))
    return rows.join(ends, "job_id", "left").filter(within).drop("end")


def replay_windows(rows: DataFrame, spec: Spec, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Replay without a fold; gives the evaluated rows only, with the same columns."""
    passed, effect = _stateless_pass(spec), effect_column(spec)
    stops = chunk_stops(rows, effect, passed)
    kept = close_jobs(chunk_effects(rows, stops), job_ends(rows, stops)).drop("chunk_stop")
    kept = kept.withColumns({"__pass": passed, "__effect": effect})
    natural = (F.col("kind") == NATURAL_END) & F.col("flag")
    closing = F.col("__effect").isin("finish", "cancel") & F.col("__pass")
    restart = F.when((F.col("__effect") == "restart") & F.col("__pass"), 1).otherwise(0)
    counted = running_sum(kept, ["job_id"], list(REPLAY_ORDER), restart, "__restarts", limit=limit, sized_by=rows)
    outcome = (
        F.when(natural | (closing & (F.col("__effect") == "finish")), "finished")
        .when(closing, "cancelled")
    )
    fired = F.when(F.col("kind") == NATURAL_END, F.col("flag")).when(
        F.col("kind") == DECISION, F.lit(False)
    ).otherwise(F.col("__pass"))
    return counted.select(
        *rows.columns,
        F.lit(True).alias("evaluated"),
        fired.alias("fired"),
        (F.col("__restarts") + spec.attempts).cast("int").alias("attempts"),
        outcome.alias("outcome"),
    )


def job_outcomes(replayed: DataFrame, jobs: DataFrame | None = None, first_attempts: int = 1) -> DataFrame:
    """Attempts, outcome and number of firings of each job; ``jobs`` adds those without any row."""
    done = replayed.groupBy("job_id").agg(
        F.max("attempts").alias("attempts"),
        F.max("outcome").alias("final_state"),
        F.count_if("fired").alias("fired"),
    )
    if jobs is not None:
        done = jobs.select("job_id").distinct().join(done, "job_id", "left")
        done = done.fillna({"attempts": first_attempts, "fired": 0})
    return done


def action_state(fired: DataFrame, action_id: Column) -> DataFrame:
    """Remembered state of each rule that ran: time and status of its last action."""
    return (
        fired.withColumn("action_id", action_id)
        .groupBy("job_id", "action_id")
        .agg(F.max("ts").alias("last_action_ts"), F.lit("success").alias("last_status"))
    )


def decide(
    submitted: Column, cancel: Column, finish: Column, start: Column, log_outcome: Column, status: Column
) -> Column:
    """What a poll does with a job, from its gates (a missing gate is NULL), the log's outcome and its status."""
    no, yes = F.lit(False), F.lit(True)
    return (
        F.when(F.coalesce(cancel, no), "cancelled")
        .when(F.coalesce(finish, no), "finished")
        .when(~submitted & F.coalesce(start, yes), "start")
        .when(~submitted, "wait")
        .when(log_outcome.isin("finished", "cancelled", "restart"), log_outcome)
        .when(status.isin(*TERMINAL), "finished")
        .otherwise("continue")
    )


def start_results(starts: DataFrame, submissions: DataFrame) -> DataFrame:
    """Jobs after a start: one more attempt each, submitted only where an id came back.

    ``starts(job_id, attempts, ts)``, ``submissions(job_id, runtime_job_id)``.
    """
    ids = submissions.select("job_id", "runtime_job_id")
    return starts.drop("runtime_job_id").join(ids, "job_id", "left").select(
        "job_id",
        (F.col("attempts") + 1).alias("attempts"),
        F.col("ts").alias("start_ts"),
        "runtime_job_id",
        F.col("runtime_job_id").isNotNull().alias("submitted"),
        F.when(F.col("runtime_job_id").isNotNull(), F.lit(0).cast("long")).alias("log_cursor"),
    )


def attempt_numbers(
    rows: DataFrame, key: str, order: Sequence[str], restart: Column, out: str = "attempt", limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Attempt a row belongs to: one more than the restarts before it."""
    hits = F.when(restart, 1).otherwise(0)
    counted = running_sum(rows, [key], list(order), hits, "__restarts", include_current=False, limit=limit)
    return counted.withColumn(out, F.col("__restarts") + 1).drop("__restarts")


def all_events(log_triggers: DataFrame, state_triggers: DataFrame) -> DataFrame:
    """Log and state firings in one table; state firings carry no effect."""
    shared = [c for c in log_triggers.columns if c in state_triggers.columns and c != "effect"]
    logs = log_triggers.select(*shared, F.lit("log").alias("source"), "effect")
    states = state_triggers.select(*shared, F.lit("state").alias("source"), F.lit(None).cast("string").alias("effect"))
    return logs.unionByName(states)

