"""How the fold proves the entry states of partitions."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import conditions as c
from tidewatch.operators import lifecycle as lc
from tidewatch.operators.actions import Action
from tidewatch.operators.cooldown import CooldownKernel, cooldown_firings
from tidewatch.operators.fold import Kernel, Steps, _resolve
from tidewatch.operators.rules import LogRule


def rule(action, condition=None):
    return LogRule("r", "x", action=Action(action), condition=condition)


class CountKernel(Kernel):
    """The worst case: every entry state matters to all that follows."""

    def run(self, state, cols, lo, hi, out):
        return ((state or 0) * 3 + hi - lo) % 1_000_003


KERNELS = {
    "cooldown": (CooldownKernel(5), 3),
    "attempts": (lc.LifecycleKernel(lc.Spec([rule("RestartAction", c.MaxAttempts(max_attempts=3)), rule("LogAction")])), 3),
    "unbounded": (lc.LifecycleKernel(lc.Spec([rule("RestartAction"), rule("LogAction", c.Cooldown(cooldown_seconds=4))])), 3),
    "long timeout": (lc.LifecycleKernel(lc.Spec([rule("RestartAction", c.Timeout(timeout_seconds=10**6)), rule("LogAction")])), 3),
    "latch": (
        lc.LifecycleKernel(
            lc.Spec([rule("RestartAction", c.Timeout(timeout_seconds=900, persistent_pass=True)), rule("LogAction")])
        ),
        3,
    ),
    "finish": (
        lc.LifecycleKernel(
            lc.Spec([rule("LogAction"), rule("FinishAction", c.Not(condition=c.Timeout(timeout_seconds=700)))])
        ),
        3,
    ),
    "count": (CountKernel(), 200),
}


@pytest.mark.parametrize("name", KERNELS)
def test_entries_are_proven_in_few_rounds(name):
    kernel, rounds = KERNELS[name]
    rng = random.Random(1)
    parts, rows, now = [], [], 0
    # One key over 60 partitions between small ones.
    for pid in range(70):
        hot = 5 <= pid < 65
        size = 20
        cols = {k: [] for k in ("__key", "__us", "chunk_seq", "kind", "rule_idx", "us", "held", "flag")}
        for i in range(size):
            now += rng.choice([1, 1, 3])
            key = "hot" if hot or pid == 4 and i > 10 or pid == 65 and i < 7 else f"k{pid}-{i // 9}"
            values = (key, now * 1_000_000, pid * size + i, lc.LOG_TRIGGER, rng.randrange(2), now * 1_000_000, [], True)
            for column, value in zip(cols, values):
                cols[column].append(value)
        rows.append(cols)
        parts.append(pid)

    def end(pid, entry):
        """State of the partition's last key at its end."""
        cols, keys = rows[pid], rows[pid]["__key"]
        start = keys.index(keys[-1])
        return kernel.run(entry if start == 0 else None, cols, start, len(keys), None)

    reports = {
        pid: {
            "first": rows[pid]["__key"][0],
            "last": rows[pid]["__key"][-1],
            "single": len(set(rows[pid]["__key"])) == 1,
            "row": {k: v[0] for k, v in rows[pid].items()},
            "exit": end(pid, None),
        }
        for pid in parts
    }
    calls = []

    def fold(asked):
        calls.append(len(asked))
        return {pid: end(pid, entry) for pid, entry in asked.items()}

    entries = _resolve(kernel, parts, reports, fold)
    state, want = None, {}
    for pid in parts:
        if pid and rows[pid]["__key"][0] == rows[pid - 1]["__key"][-1]:
            want[pid] = state
        state = end(pid, state)
    assert entries.keys() == want.keys()
    for pid, entry in want.items():
        # Reduced states may differ in what no longer matters; what follows must not.
        assert kernel.reduce(entries[pid], reports[pid]["row"]) == kernel.reduce(entry, reports[pid]["row"])
    assert len(calls) <= rounds


def periodic(n, every, jitter, seed=2):
    rng = random.Random(seed)
    return [int((i * every + rng.random() * jitter) * 1_000_000) for i in range(n)]


@pytest.mark.parametrize(("parts", "cooldown", "jitter"), [(64, 60, 0), (256, 601, 0), (256, 3600, 0), (256, 601, 0.9), (64, 60, 0.9), (256, 10**6, 0), (64, 0, 0)])
def test_cooldowns_of_a_steady_key_compose(parts, cooldown, jitter):
    """One row a second in uneven parts, the case in which guesses fail: functions give each entry, alone and composed."""
    kernel = CooldownKernel(cooldown)
    times = periodic(parts * 40, 1, jitter)
    rng = random.Random(3)
    cuts = [0, *sorted(rng.sample(range(1, len(times)), parts - 1)), len(times)]
    runs = [times[a:b] for a, b in zip(cuts, cuts[1:])]
    entry = kernel.run(None, {"__us": runs[0]}, 0, len(runs[0]), None)
    functions = [kernel.transfer({"__us": np.array(run)}).merged() for run in runs[1:]]
    whole, state, wanted = functools.reduce(Steps.then, functions), np.array([entry]), entry
    for run, function in zip(runs[1:], functions):
        wanted = kernel.run(wanted, {"__us": run}, 0, len(run), None)
        state = function(state)
        assert state[0] == wanted
    assert whole(np.array([entry]))[0] == wanted


def test_functions_from_no_state_and_merged():
    steps = Steps(np.array([1, 5, 9]), np.array([10, 10, 20])).merged()
    assert steps.breaks.tolist() == [5, 9]
    assert steps(np.array([-(2**63), 5, 6, 30])).tolist() == [10, 10, 20, 30]
    nothing = Steps(np.array([], np.int64), np.array([], np.int64))
    assert nothing(np.array([3])).tolist() == [3] and nothing.then(steps)(np.array([3, 40])).tolist() == [10, 40]


def test_jobs_for_a_hot_key_do_not_grow_with_its_partitions(spark):
    """Two hot keys, one steady and one in bursts, beside small ones."""
    rows = [("hot", t, i) for i, t in enumerate(periodic(4000, 1, 0))] + [("wild", t, i) for i, t in enumerate(sorted(periodic(1500, 3, 400)))]
    rows += [(f"k{i % 90}", i * 1_000_000, i) for i in range(500)]
    frame = spark.createDataFrame(rows, "key string, us long, id long").withColumn("ts", F.timestamp_micros("us")).repartition(4)
    seconds, want = 601, {}
    last = {}
    for key, us, i in sorted(rows):
        fires = key not in last or us - last[key] >= seconds * 1_000_000
        if fires:
            last[key] = us
        want[key, i] = fires
    jobs = []
    for parts in (16, 64):
        spark.sparkContext.setJobGroup(f"fold-{parts}", "count jobs")
        got = {(r["key"], r["id"]): r["fired"] for r in cooldown_firings(frame, "key", ["ts", "id"], seconds, partitions=parts).collect()}
        assert got == want
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fold-{parts}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] <= 16
