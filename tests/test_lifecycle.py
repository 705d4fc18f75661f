"""The replay against a model that walks poll by poll, for random jobs and rule sets."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import conditions as c
from tidewatch.operators import lifecycle as lc
from tidewatch.operators.actions import Action
from tidewatch.operators.rules import LogRule, StateRule

EPOCH = datetime.datetime(2024, 1, 1)
ROWS = "job_id string, chunk_seq long, kind int, rule_idx int, match_seq int, us long, flag boolean, value int"
BIG = c.Custom(kind="Big")
c.register_condition("Big", lambda _, scope: (F.col("value") > 5, F.lit("")))


def act(kind):
    return Action(kind)


STATEFUL = lc.Spec(
    log_rules=[
        LogRule("r0", "x", action=act("RestartAction"), condition=c.And(c.MaxAttempts(max_attempts=4), BIG)),
        LogRule("r1", "x"),
        LogRule("r2", "x", action=act("LogAction"), condition=c.Cooldown(cooldown_seconds=5)),
        LogRule("r3", "x", action=act("LogAction"), condition=c.And(BIG, c.Timeout(timeout_seconds=12), persistent_pass=True)),
        LogRule("r4", "x", action=act("LogAction"), condition=c.Or(c.Timeout(timeout_seconds=9), BIG, persistent_fail=True)),
        LogRule("r5", "x", action=act("FinishAction"), condition=c.And(BIG, c.Not(condition=c.Timeout(timeout_seconds=40)))),
    ],
    state_rules=[StateRule("s0", action=act("CancelAction"), condition=c.Cooldown(cooldown_seconds=7))],
    start=c.Not(condition=c.Timeout(timeout_seconds=3)),
    cancel=c.And(BIG, c.Not(condition=c.Timeout(timeout_seconds=70))),
    submitted=False,
    attempts=0,
)
FREE = lc.Spec(
    log_rules=[
        LogRule("r0", "x", action=act("RestartAction"), condition=BIG),
        LogRule("r1", "x", action=act("LogAction"), condition=c.Cooldown(cooldown_seconds=4)),
    ]
)
STATELESS = lc.Spec(
    log_rules=[
        LogRule("r0", "x", action=act("RestartAction"), condition=c.Or(BIG, c.Not(condition=BIG))),
        LogRule("r1", "x", action=act("LogAction"), condition=c.Not(condition=BIG)),
        LogRule("r2", "x", action=act("FinishAction"), condition=c.And(BIG, BIG)),
        LogRule("r3", "x", action=act("CancelAction"), condition=BIG),
    ],
    state_rules=[StateRule("s0", action=act("CancelAction"))],
)


class Job:
    """One job of the model."""

    def __init__(self, spec):
        self.spec, self.submitted, self.attempts = spec, spec.submitted, spec.attempts
        self.outcome, self.memory = None, {}

    def check(self, node, now, value, memory):
        if isinstance(node, c.MaxAttempts):
            return self.attempts < node.max_attempts
        if isinstance(node, c.Cooldown):
            return memory.get("last") is None or now - memory["last"] >= node.cooldown_seconds
        if isinstance(node, c.Timeout):
            return now - memory["started"] < node.timeout_seconds
        if isinstance(node, c.Not):
            return not self.check(node.condition, now, value, memory)
        if isinstance(node, c.Composite):
            results = [self.check(child, now, value, memory) for child in node.conditions]
            return all(results) if node.mode == "all" else any(results)
        return value > 5

    def gate(self, key, condition, now, value):
        memory = self.memory.setdefault(key, {})
        if condition is None:
            return True
        memory.setdefault("started", now)
        passed = self.check(condition, now, value, memory)
        if "latch" in memory:
            return memory["latch"]
        if passed and condition.persistent_pass or not passed and condition.persistent_fail:
            memory["latch"] = passed
        return passed

    def poll(self, rows):
        """Rows of one poll in order; yields (evaluated, fired, attempts, outcome) for each."""
        stopped = False
        for kind, rule, now, flag, value in rows:
            seen = fired = False
            if self.outcome is None and kind == lc.DECISION:
                seen = True
                for label, outcome in (("cancel", "cancelled"), ("finish", "finished")):
                    condition = getattr(self.spec, label)
                    if condition is not None and self.gate(label, condition, now, value):
                        self.outcome, fired = outcome, True
                        break
                else:
                    if not self.submitted:
                        stopped = True
                        if self.gate("start", self.spec.start, now, value):
                            self.attempts, self.submitted, fired = self.attempts + 1, flag, True
            elif self.outcome is None and kind == lc.STATE_TRIGGER:
                seen = True
                fired = self.fire("state", self.spec.state_rules, rule, now, value) is not None
            elif self.outcome is None and self.submitted and not stopped:
                seen = True
                if kind == lc.NATURAL_END:
                    fired = flag
                    self.outcome = "finished" if flag else None
                else:
                    effect = self.fire("log", self.spec.log_rules, rule, now, value)
                    fired = effect is not None
                    if effect == "restart":
                        self.attempts, stopped = self.attempts + 1, True
                    elif effect in ("finish", "cancel"):
                        self.outcome = {"finish": "finished", "cancel": "cancelled"}[effect]
            yield seen, fired, self.attempts, self.outcome

    def fire(self, source, rules, rule, now, value):
        key = (source, rule)
        if not self.gate(key, rules[rule].condition, now, value):
            return None
        self.memory.setdefault(key, {})["last"] = now
        return rules[rule].action.effect


def model(rows, spec):
    jobs, out = {}, {}
    ordered = sorted(rows, key=lambda r: r[:5])
    polls = {}
    for row in ordered:
        polls.setdefault((row[0], row[1]), []).append(row)
    for (job, _), part in polls.items():
        state = jobs.setdefault(job, Job(spec))
        results = state.poll([(r[2], r[3], r[5] / 1e6, r[6], r[7]) for r in part])
        out.update({row[:5]: result for row, result in zip(part, results)})
    return out


def random_rows(spec, seed, polls=True, hot=400):
    rng = random.Random(seed)
    rows = []
    log = [i for i, r in enumerate(spec.log_rules) if r.action]
    state = [i for i, r in enumerate(spec.state_rules) if r.action]
    for job in ["hot", *[f"j{i}" for i in range(25)]]:
        now = rng.randrange(1000)
        for chunk in range(hot if job == "hot" else rng.randrange(1, 25)):
            now += rng.choice([1, 1, 2, 8])
            us = now * 1_000_000
            for rule in state:
                if rng.random() < 0.3:
                    rows.append((job, chunk, lc.STATE_TRIGGER, rule, 0, us, True, rng.randrange(10)))
            for rule in log:
                for seq in range(rng.choice([0, 0, 1, 2])):
                    value = rng.randrange(10) if rng.random() < 0.7 else 0
                    rows.append((job, chunk, lc.LOG_TRIGGER, rule, seq, us, True, value))
            if polls:
                rows.append((job, chunk, lc.DECISION, 0, 0, us, rng.random() < 0.8, rng.randrange(10)))
                rows.append((job, chunk, lc.NATURAL_END, 0, 0, us, rng.random() < 0.02, 0))
    rng.shuffle(rows)
    return rows


def with_held(frame, spec):
    """Leaves that hold on every row, by its kind and rule."""
    held = []
    scope = c.Scope()
    for key, gate in spec.gates.items():
        if key in lc.LABELS:
            here = F.col("kind") == lc.DECISION
            found = lc.held_leaves(gate, scope, lc.LABEL_STEP * lc.LABELS.index(key))
        else:
            kind, rule = (int(x) for x in key.split(":"))
            here = (F.col("kind") == kind) & (F.col("rule_idx") == rule)
            found = lc.held_leaves(gate, scope)
        held.append(F.when(here, found).otherwise(lc.numbers_of([])))
    return frame.withColumn("held", F.concat(*held))


def as_dict(frame):
    return {
        (r.job_id, r.chunk_seq, r.kind, r.rule_idx, r.match_seq): (r.evaluated, r.fired, r.attempts, r.outcome)
        for r in frame.collect()
    }


@pytest.mark.parametrize("partitions", [1, 5, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_model(spark, partitions, seed):
    rows = random_rows(STATEFUL, seed)
    frame = with_held(spark.createDataFrame(rows, ROWS), STATEFUL)
    assert as_dict(lc.replay_fold(frame, STATEFUL, partitions)) == model(rows, STATEFUL)


def test_fold_of_a_hot_job_that_never_ends(spark):
    """Attempts grow without bound, so entry states agree only after they are reduced."""
    rows = random_rows(FREE, 5, polls=False, hot=900)
    frame = with_held(spark.createDataFrame(rows, ROWS), FREE)
    got = as_dict(lc.replay_fold(frame, FREE, 30))
    assert got == model(rows, FREE)
    assert max(r[2] for r in got.values()) > 100


@pytest.mark.parametrize("limit,polls", [(20, False), (5_000_000, False), (20, True)])
def test_windows_equal_model_on_evaluated_rows(spark, limit, polls):
    assert lc.plan_kind(STATELESS) == "windows" and lc.plan_kind(STATEFUL) == "fold"
    # Mostly restarts and messages, so that jobs live on for a while.
    rows = [r for r in random_rows(STATELESS, 9, polls=polls) if r[2] != lc.LOG_TRIGGER or r[3] < 2 or r[1] % 17 == 3]
    frame = with_held(spark.createDataFrame(rows, ROWS), STATELESS)
    want = {key: value for key, value in model(rows, STATELESS).items() if value[0]}
    got = as_dict(lc.replay(frame, STATELESS, limit=limit))
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    ended = {(k[0], v[3]) for k, v in got.items() if v[3]}
    assert ended == {(k[0], v[3]) for k, v in want.items() if v[3]}


def triggers(spark, rows):
    return spark.createDataFrame(
        [(job, chunk, EPOCH + datetime.timedelta(seconds=s), rule, 0) for job, chunk, s, rule in rows],
        "job_id string, chunk_seq long, ts timestamp_ntz, rule_idx int, match_seq int",
    )


def run(spark, spec, rows):
    return {r.job_id: r for r in lc.job_outcomes(lc.replay(lc.trigger_rows(triggers(spark, rows), spec), spec)).collect()}


def test_restart_counts_attempts(spark):
    spec = lc.Spec(log_rules=[LogRule("oom", "OOM", action=act("RestartAction"))])
    assert run(spark, spec, [("a", 0, 0, 0)])["a"].attempts == 2


def test_cancel_by_log(spark):
    spec = lc.Spec(log_rules=[LogRule("c", "CANCEL", action=act("CancelAction"))])
    assert run(spark, spec, [("a", 0, 0, 0)])["a"].final_state == "cancelled"


def test_cooldown_blocks_second_firing(spark):
    spec = lc.Spec(log_rules=[LogRule("m", "x", action=act("LogAction"), condition=c.Cooldown(cooldown_seconds=60))])
    assert run(spark, spec, [("a", 0, 0, 0), ("a", 1, 1, 0)])["a"].fired == 1


def poll_frame(spark, rows):
    return spark.createDataFrame(
        [("a", i, EPOCH + datetime.timedelta(seconds=i), status, True, there) for i, (status, there) in enumerate(rows)],
        "job_id string, chunk_seq long, ts timestamp_ntz, status string, submit_ok boolean, there boolean",
    )


c.register_condition("There", lambda _, scope: (F.col("there"), F.lit("")))
THERE = c.Custom(kind="There")


def replay_polls(spark, spec, rows):
    done = lc.replay_fold(lc.poll_rows(poll_frame(spark, rows), spec), spec)
    return done.orderBy("chunk_seq", "kind").collect()


def test_start_gate(spark):
    spec = lc.Spec(start=THERE, submitted=False, attempts=0)
    done = replay_polls(spark, spec, [(None, False), (None, True)])
    assert [(r.fired, r.attempts) for r in done if r.kind == lc.DECISION] == [(False, 0), (True, 1)]


def test_finish_gate_and_natural_end(spark):
    spec = lc.Spec(finish=THERE)
    done = replay_polls(spark, spec, [("RUNNING", False), ("RUNNING", True)])
    assert [r.outcome for r in done] == [None, None, "finished", "finished"]
    done = replay_polls(spark, lc.Spec(), [("RUNNING", False), ("FAILED", False)])
    assert [r.outcome for r in done if r.kind == lc.NATURAL_END] == [None, "finished"]


def test_pending_jobs_can_be_cancelled_or_finished(spark):
    for label, outcome in (("cancel", "cancelled"), ("finish", "finished")):
        spec = lc.Spec(submitted=False, attempts=0, **{label: c.AlwaysTrue()})
        done = replay_polls(spark, spec, [(None, False), (None, False)])
        assert done[-1].outcome == outcome and done[-1].attempts == 0


def test_decision_table(spark):
    frame = spark.createDataFrame(
        [
            (1, False, True, True, True, "x", None, "cancelled"),
            (2, False, None, True, True, "x", None, "finished"),
            (3, False, None, None, None, "x", None, "start"),
            (4, False, False, False, False, "restart", None, "wait"),
            (5, True, None, None, False, "restart", "COMPLETED", "restart"),
            (6, True, None, None, None, "continue", "FAILED", "finished"),
            (7, True, None, None, None, "continue", None, "continue"),
        ],
        T._parse_datatype_string(
            "id int, submitted boolean, cancel boolean, finish boolean, start boolean, log string, status string, want string"
        ),
    )
    decision = lc.decide(*[F.col(x) for x in ("submitted", "cancel", "finish", "start", "log", "status")])
    assert all(r.got == r.want for r in frame.withColumn("got", decision).collect())


def test_start_results(spark):
    starts = spark.createDataFrame([("a", 0, 1), ("b", 2, 1)], "job_id string, attempts int, ts int")
    ids = spark.createDataFrame([("a", "pid1")], "job_id string, runtime_job_id string")
    got = {r.job_id: (r.attempts, r.submitted, r.log_cursor) for r in lc.start_results(starts, ids).collect()}
    assert got == {"a": (1, True, 0), "b": (3, False, None)}


def test_a_tree_may_have_any_number_of_leaves(spark):
    many = c.And(*[BIG] * 70, c.Not(condition=c.And(*[BIG, c.Not(condition=BIG)])))
    spec = lc.Spec([LogRule("r", "x", action=act("LogAction"), condition=many)], cancel=c.And(*[BIG] * 40))
    rows = [("j", k, kind, 0, 0, k, True, value) for k, (kind, value) in enumerate([(2, 9), (2, 1), (1, 2), (2, 7), (1, 8), (2, 9)])]
    frame = with_held(spark.createDataFrame(rows, ROWS), spec)
    got = lc.replay_fold(frame, spec).orderBy("chunk_seq").collect()
    assert [(r.evaluated, r.fired, r.outcome) for r in got] == [
        (True, True, None), (True, False, None), (True, False, None), (True, True, None), (True, True, "cancelled"), (False, False, "cancelled"),
    ]
