"""Jobs on disk, each replayed by its own definition."""

import datetime
import json

import pytest

from tidewatch.operators import lifecycle as lc
from tidewatch.operators.registry_replay import replay_registry
from tidewatch.operators.transitions import status_changes
from tidewatch.sources import registry
from tidewatch.sources.definitions import condition_from, spec_from

EPOCH = datetime.datetime(2024, 1, 1)


def at(seconds):
    return EPOCH + datetime.timedelta(seconds=seconds)


def rule(name, pattern, action, condition=None, **more):
    return {"name": name, "pattern": pattern, "action": {"class_name": action, "message": "m"}, "condition": condition, **more}


READY = {"class_name": "FileExistsCondition", "path": "/{team}/{job_id}.ready"}
DEFINITIONS = {
    "retry": {"log_events": [rule("oom", "OOM", "RestartAction", {"class_name": "MaxAttemptsCondition", "max_attempts": 2})]},
    "stop": {"log_events": [rule("off", "x", None), rule("bad", "ERR\\d", "CancelAction", pattern_type="regex")]},
    "wait": {
        "start_condition": {"class_name": "AndCondition", "conditions": [READY, {"class_name": "TimeoutCondition", "timeout_seconds": 100}]},
        "log_events": [rule("tick", "tick", "LogAction", {"class_name": "CooldownCondition", "cooldown_seconds": 3})],
        "finish_condition": {"class_name": "GlobExistsCondition", "pattern": "/{team}/{job_id}.out.*", "min_matches": 2},
    },
    "state": {"state_events": [{"name": "s", "transition": [None, "RUNNING"], "action": {"class_name": "LogAction"}}]},
}
JOBS = {"a": "retry", "b": "stop", "c": "wait", "d": "wait", "e": "state"}


@pytest.fixture
def jobs(spark, tmp_path):
    for job, kind in JOBS.items():
        body = {"class_name": "LocalJob", "name": job, "metadata": {"team": "t"}, **DEFINITIONS[kind]}
        if kind == "stop":
            body["log_events"][0]["action"] = None
        runtime = {"submitted": kind != "wait", "attempts": 0 if kind == "wait" else 1}
        (tmp_path / f"{job}.job.json").write_text(json.dumps({"job_id": job, "definition": body, "runtime": runtime}))
    return registry.flatten(registry.scan(registry.read_records(spark, str(tmp_path))))


def test_each_job_by_its_own_definition(spark, jobs):
    text = [("a", i, "OOM") for i in (1, 2, 3)] + [("b", 1, "fine"), ("b", 2, "x ERR7"), ("b", 3, "ERR8")]
    text += [(job, i, "tick") for job in "cd" for i in range(10)]
    chunks = spark.createDataFrame([(j, i, at(i), t) for j, i, t in text], "job_id string, chunk_seq int, ts timestamp_ntz, text string")
    statuses = {(job, i): "RUNNING" if job in "ab" or i > 0 else None for job in JOBS for i in range(10)}
    statuses["a", 9] = "COMPLETED"
    polls = spark.createDataFrame([(j, i, at(i), s, True) for (j, i), s in statuses.items()], "job_id string, chunk_seq int, ts timestamp_ntz, status string, submit_ok boolean")
    changes = status_changes(polls.select("job_id", "chunk_seq", "ts", "status"), "job_id", ["ts"])
    files = [("/t/c.ready", 2), ("/t/c.out.1", 4), ("/t/c.out.2", 6), ("/t/other.out.1", 0)]
    markers = spark.createDataFrame([(p, "", at(s)) for p, s in files], "path string, content string, ts timestamp_ntz")
    done = replay_registry(jobs, chunks, polls, markers, changes, partitions=3).collect()

    def of(job, kind=None):
        rows = sorted((r for r in done if r.job_id == job), key=lambda r: (r.chunk_seq, r.kind, r.rule_idx))
        return [r for r in rows if kind is None or r.kind == kind]

    assert [(r.fired, r.attempts) for r in of("a", lc.LOG_TRIGGER)] == [(True, 2), (False, 2), (False, 2)]
    assert of("a")[-1].outcome == "finished"
    assert [(r.chunk_seq, r.rule_idx, r.fired, r.outcome) for r in of("b", lc.LOG_TRIGGER)] == [(2, 1, True, "cancelled"), (3, 1, False, "cancelled")]
    # Starts at 2 when the marker is there, logs from 3 on every three seconds, ends at 6 with the second output.
    assert [r.chunk_seq for r in of("c", lc.DECISION) if r.fired] == [2, 6]
    assert [r.chunk_seq for r in of("c", lc.LOG_TRIGGER) if r.fired] == [3]
    assert of("c")[-1].outcome == "finished" and of("c")[-1].attempts == 1
    assert not any(r.fired for r in of("d")) and of("d")[-1].attempts == 0
    assert [(r.chunk_seq, r.fired) for r in of("e", lc.STATE_TRIGGER)] == [(1, True)]


def test_definitions_are_read_whole():
    tree = {
        "class_name": "CompositeCondition",
        "mode": "any",
        "persistent_pass": True,
        "conditions": [
            {"class_name": "NotCondition", "condition": {"class_name": "AlwaysTrueCondition"}},
            {"class_name": "MetadataCondition", "key": "k", "within": [1, "a"]},
            {"class_name": "CooldownCondition", "cooldown_seconds": 2, "note": "n"},
            {"class_name": "FileContentCondition", "path": "p", "pattern": "x", "mode": "regex"},
            {"class_name": "Own", "limit": 3},
        ],
    }
    read = condition_from(json.dumps(tree))
    assert read.mode == "any" and read.persistent_pass and len(read.conditions) == 5
    assert read.conditions[1].within == (1, "a") and read.conditions[4].options == {"limit": 3}
    assert condition_from(None) is None
    spec = spec_from({"log_events": [{"name": "n", "pattern": "x"}], "submitted": False, "attempts": 0})
    assert spec.log_rules[0].action is None and not spec.submitted
    with pytest.raises(ValueError):
        spec_from({"log_events": [{"name": "n", "pattern": "x", "action": {"class_name": "Unknown"}}]})


def test_conditions_of_rules_see_the_event(spark, tmp_path, monkeypatch):
    """Each job's rule waits for a file whose name comes from another part of the scope."""
    from tidewatch.operators import registry_replay as rr

    paths = {
        "group": "/out/{shard}.ok", "name": "/out/{event_name}.ok", "unknown": "/out/{nope}.ok", "own_id": "/out/{job_id}.ok",
        "match": "/out/{match}.ok", "meta": "/out/{kind}.ok", "id": "/out/{event_id}.ok",
    }
    files = ["/out/07.ok", "/out/hit.ok", "/out/{nope}.ok", "/out/own_id.ok", "/out/shard 07.ok", "/out/rule.ok", "/out/id:hit:1704067201000.ok"]
    for job, path in paths.items():
        gate = {"class_name": "FileExistsCondition", "path": path}
        more = {"pattern_type": "regex", "extract_groups": {"shard": "1"}, "metadata": {"kind": "rule"}}
        body = {"name": job, "metadata": {"job_id": "mine"}, "log_events": [rule("hit", r"shard (\d+)", "FinishAction", gate, **more)]}
        (tmp_path / f"{job}.job.json").write_text(json.dumps({"job_id": job, "definition": body, "runtime": {"submitted": True, "attempts": 1}}))
    jobs = registry.flatten(registry.scan(registry.read_records(spark, str(tmp_path))))
    chunks = spark.createDataFrame([(j, 1, at(1), "shard 07 done") for j in paths], "job_id string, chunk_seq int, ts timestamp_ntz, text string")
    polls = spark.createDataFrame([], "job_id string, chunk_seq int, ts timestamp_ntz, status string, submit_ok boolean")
    shape = "path string, content string, ts timestamp_ntz"

    def fired(names):
        markers = spark.createDataFrame([(p, "", at(0)) for p in names], shape)
        return {r.job_id for r in rr.replay_registry(jobs, chunks, polls, markers, partitions=2).collect() if r.fired}

    assert fired(files) == set(paths)
    assert fired(["/out/None.ok", "/out/mine.ok"]) == set()
    # One definition at a time gives the same.
    monkeypatch.setattr(rr, "BATCH_DEFINITIONS", 3)
    assert fired(files) == set(paths)


def test_a_restart_that_is_not_submitted_waits_for_its_start(spark):
    spec = lc.Spec([lc_rule("oom", "RestartAction"), lc_rule("note", "LogAction")])
    hits = [("j", 1, 0, False), ("j", 1, 1, True), ("j", 2, 1, True), ("j", 4, 1, True)]
    frame = spark.createDataFrame([(j, c, r, 0, at(c), ok) for j, c, r, ok in hits], "job_id string, chunk_seq long, rule_idx int, match_seq int, ts timestamp_ntz, submit_ok boolean")
    polls = spark.createDataFrame([("j", c, at(c), "RUNNING", c >= 3) for c in (1, 2, 3, 4)], "job_id string, chunk_seq long, ts timestamp_ntz, status string, submit_ok boolean")
    rows = lc.trigger_rows(frame, spec).unionByName(lc.poll_rows(polls, spec))
    got = lc.replay(rows, spec).filter("fired").orderBy(*lc.REPLAY_ORDER).collect()
    # The failed start of chunk 2 counts as an attempt too; chunk 3 starts, chunk 4 is read again.
    assert [(r.chunk_seq, r.kind, r.rule_idx, r.attempts) for r in got] == [(1, 2, 0, 2), (2, 1, 0, 3), (3, 1, 0, 4), (4, 2, 1, 4)]


def lc_rule(name, action):
    from tidewatch.operators.actions import Action
    from tidewatch.operators.rules import LogRule

    return LogRule(name, "x", action=Action(action))


def test_a_replay_goes_on_from_what_records_remember(spark, tmp_path):
    base = EPOCH.replace(tzinfo=datetime.timezone.utc).timestamp()
    cool, late = {"class_name": "CooldownCondition", "cooldown_seconds": 60}, {"class_name": "TimeoutCondition", "timeout_seconds": 30}
    never = {"class_name": "NotCondition", "condition": {"class_name": "AlwaysTrueCondition"}, "persistent_pass": True}
    body = {"name": "n", "log_events": [rule("a", "x", "LogAction", cool), rule("b", "x", "LogAction", late), rule("c", "x", "LogAction", never)]}
    kept = {
        "log:a:0": {"last_action_ts": base + 5, "last_status": "success", "condition": {"started_ts": base}},
        "log:b:1": {"condition": {"started_ts": base - 20}},
        "log:c:2": {"condition": {"started_ts": base, "latched_pass": True}},
    }
    for job, state in (("fresh", {}), ("kept", kept)):
        runtime = {"submitted": True, "attempts": 1, "action_state": state, "condition_state": {}}
        (tmp_path / f"{job}.job.json").write_text(json.dumps({"job_id": job, "definition": body, "runtime": runtime}))
    jobs = registry.flatten(registry.scan(registry.read_records(spark, str(tmp_path))))
    chunks = spark.createDataFrame([(j, k, at(s), "x") for j in ("fresh", "kept") for k, s in enumerate((6, 15, 70))], "job_id string, chunk_seq int, ts timestamp_ntz, text string")
    polls = spark.createDataFrame([], "job_id string, chunk_seq int, ts timestamp_ntz, status string, submit_ok boolean")
    done = replay_registry(jobs, chunks, polls, partitions=2).filter("fired").collect()
    got = {job: sorted((r.rule_idx, r.chunk_seq) for r in done if r.job_id == job) for job in ("fresh", "kept")}
    assert got == {"fresh": [(0, 0), (0, 2), (1, 0), (1, 1)], "kept": [(0, 2), (1, 0), (2, 0), (2, 1), (2, 2)]}
