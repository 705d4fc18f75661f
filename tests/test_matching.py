"""Rules on log text against Python's own matcher."""

import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.actions import Action, action_results, job_requests, register_action
from tidewatch.operators.conditions import MaxAttempts
from tidewatch.operators.matching import match_registry_rules, match_triggers
from tidewatch.operators.rules import LogRule, StateRule, active
from tidewatch.operators.transitions import (
    attach_status,
    latest_status,
    match_state_rule_table,
    match_state_rules,
    merge_status,
)

NOTE = Action("LogAction", "event {event_name}")


def chunks(spark, *texts):
    data = [("j", i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "job_id string, chunk_seq int, text string")


def hits(spark, texts, *rules, payload=True):
    found = match_triggers(chunks(spark, *texts), list(rules), ["job_id", "chunk_seq"], payload)
    return found.orderBy("chunk_seq", "rule_idx", "match_seq").collect()


def rule(pattern, kind="regex", **options):
    return LogRule("e", pattern, kind, action=NOTE, **options)


def test_two_hits(spark):
    got = hits(spark, ["row-7 read, row-318 fine\nrow-0"], rule(r"row-(\d+)", match_once=False))
    assert [r.match for r in got] == ["row-7", "row-318", "row-0"]
    assert [r.match for r in hits(spark, ["row-318 row-7"], rule(r"row-(\d+)"))] == ["row-318"]


@pytest.mark.parametrize("once", [True, False])
def test_groups(spark, once):
    got = hits(spark, ["epoch=7"], rule(r"epoch=(\d+)", match_once=once, extract_groups={"epoch": 1, "full": "match", "missing": 99}))
    assert got[0].payload == {"match": "epoch=7", "line": "epoch=7", "epoch": "7", "full": "epoch=7"}


def test_groups_may_overwrite_and_be_absent(spark):
    r = rule(r"a(?P<x>b)?(?P<y>c)", match_once=False, extract_groups={"line": "y", "x": "x"}, metadata={"team": "t"})
    got = hits(spark, ["ac abc"], r)
    assert [(x.payload["line"], x.payload["x"], x.payload["team"]) for x in got] == [("c", None, "t"), ("c", "b", "t")]


def test_groups_of_patterns_that_look_around(spark):
    r = rule(r"\b(\w)(?=\w*!)", match_once=False, extract_groups={"first": 1})
    assert [x.payload["first"] for x in hits(spark, ["one two! six!"], r)] == ["t", "s"]


TEXTS = ["aaaa aa\naXa", "", "no", "License license License\n.", "$x.y $x.y", "é\nendé"]


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("kind,pattern", [("substring", "aa"), ("substring", "$x.y"), ("substring", "\n"), ("substring", ""), ("regex", "^."), ("regex", "a*"), ("regex", "License$"), ("regex", r"\w+é")])
def test_hits_equal_python(spark, kind, pattern, once):
    r = rule(pattern, kind, match_once=once)
    got = [(x.chunk_seq, x.match) for x in hits(spark, TEXTS, r, payload=False)]
    python = re.compile(pattern if kind == "regex" else re.escape(pattern), re.MULTILINE)
    want = []
    for i, text in enumerate(TEXTS):
        found = [m.group(0) for m in python.finditer(text)] if text else []
        want += [(i, m) for m in (found[:1] if once else found)]
    assert got == want


def test_once_means_once_per_chunk(spark):
    assert len(hits(spark, ["x x", "x"], rule("x"))) == 2


def test_hits_past_a_certain_effect_can_be_cut(spark):
    rules = [
        rule("a", match_once=False),
        LogRule("gated", "b", action=Action("CancelAction"), condition=MaxAttempts(max_attempts=2), match_once=False),
        LogRule("sure", "c", action=Action("RestartAction"), match_once=False),
        rule("d"),
    ]
    found = match_triggers(chunks(spark, "d c b a c a", "d b", ""), rules, ["chunk_seq"], False, cut_after_effect=True)
    got = sorted((r.chunk_seq, r.rule_idx, r.match_seq) for r in found.collect())
    assert got == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 2, 0), (1, 1, 0), (1, 3, 0)]


def test_rules_without_action_keep_their_number(spark):
    got = hits(spark, ["x"], LogRule("silent", "x"), rule("x"))
    assert [r.rule_idx for r in got] == [1]
    assert hits(spark, ["x"], LogRule("silent", "x")) == []


def test_matching_needs_no_shuffle(spark):
    plan = match_triggers(chunks(spark, "x"), [rule("x"), rule("y", "substring")], ["job_id"])
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit,sent", [(200, 100), (200, 1), (1, 100)])
def test_rules_of_each_job(spark, limit, sent):
    rules = [
        ("a", 0, "n", "x", "substring", False),
        ("a", 1, "m", r"(?P<d>\d)+", "regex", True),
        ("b", 0, "n", "x", "substring", True),
        ("b", 3, "dot", ".", "substring", False),
        ("b", 4, "quiet", "x", "inactivity", False),
        ("b", 5, "unset", "x", None, None),
        ("b", 6, "nothing", None, "substring", True),
        ("b", 7, "empty", "", "regex", True),
    ]
    table = spark.createDataFrame(rules, "job_id string, rule_idx int, name string, pattern string, pattern_type string, match_once boolean")
    text = spark.createDataFrame([("a", 0, "xx 12 3"), ("b", 0, "x.x."), ("c", 0, "x1"), ("a", 1, "")], "job_id string, chunk_seq int, text string")
    got = match_registry_rules(text, table, ["chunk_seq"], limit, sent).collect()
    assert sorted((r.job_id, r.rule_idx, r.rule_name, r.match_seq, r.match) for r in got) == [
        ("a", 0, "n", 0, "x"),
        ("a", 0, "n", 1, "x"),
        ("a", 1, "m", 0, "12"),
        ("b", 0, "n", 0, "x"),
        ("b", 3, "dot", 0, "."),
        ("b", 3, "dot", 1, "."),
        ("b", 5, "unset", 0, "x"),
    ]


def test_messages_and_requests(spark):
    kinds = ("LogAction", "RestartAction", "FinishAction", "CancelAction")
    rules = [rule("x"), LogRule("more", "MORE", action=Action("NewJobAction", job_config="sub"))]
    rules += [LogRule(kind, "x", action=Action(kind)) for kind in kinds] + [LogRule("mute", "x", action=Action("LogAction", ""))]
    found = match_triggers(chunks(spark, "x MORE"), rules, ["job_id"]).withColumn("event_name", F.lit("spill"))
    done = action_results(found, active(rules), F.create_map(F.lit("event_name"), F.col("event_name"))).orderBy("rule_idx").collect()
    assert [(r.effect, r.outcome, r.message) for r in done] == [
        ("noop", "continue", "event spill"),
        ("noop", "continue", "Submitting local command job"),
        ("noop", "continue", "Event spill triggered"),
        ("restart", "restart", "restarting job"),
        ("finish", "finished", "finished"),
        ("cancel", "cancelled", "cancelled"),
        ("noop", "continue", ""),
    ]
    assert [(r.job_id, r.job_config) for r in job_requests(found, active(rules)).collect()] == [("j", "sub")]


def test_unknown_actions_and_kinds_are_refused():
    with pytest.raises(ValueError):
        Action("Nothing")
    with pytest.raises(ValueError):
        LogRule("e", "x", "glob")
    with pytest.raises(ValueError):
        register_action("LogAction", lambda a, v: ("noop", v))
    with pytest.raises(re.error):
        LogRule("e", "(", "regex")


def changes(spark):
    data = [("a", None, "RUNNING"), ("a", "RUNNING", "FAILED"), ("b", "RUNNING", None)]
    return spark.createDataFrame(data, "job_id string, old_status string, new_status string")


def test_state_rules(spark):
    rules = [StateRule("running", None, "RUNNING", action=NOTE), StateRule("left", "RUNNING", None, action=NOTE), StateRule("any", action=NOTE), StateRule("off")]
    got = {(r.job_id, r.new_status, r.rule_idx) for r in match_state_rules(changes(spark), rules).collect()}
    assert got == {
        ("a", "RUNNING", 0), ("a", "RUNNING", 2), ("a", "FAILED", 1), ("a", "FAILED", 2), ("b", None, 1), ("b", None, 2)
    }
    assert match_state_rules(changes(spark), [StateRule("off")]).count() == 0


def test_state_rules_of_each_job(spark):
    table = spark.createDataFrame([("a", 0, "f", None, "FAILED"), ("b", 1, "gone", "RUNNING", None), ("b", 2, "f", None, "FAILED")], "job_id string, rule_idx int, name string, old string, new string")
    got = match_state_rule_table(changes(spark), table).collect()
    assert {(r.job_id, r.rule_idx) for r in got} == {("a", 0), ("b", 1)}


def test_status_feeds(spark):
    first = spark.createDataFrame([("1", "RUNNING"), ("2", "RUNNING")], "runtime_job_id string, status string")
    second = spark.createDataFrame([("2", None), ("3", "FAILED")], "runtime_job_id string, status string")
    got = {r.runtime_job_id: r.status for r in merge_status(first, second).collect()}
    assert got["1"] == "RUNNING" and got["3"] == "FAILED"
    jobs = spark.createDataFrame([("j1", "1"), ("j2", None), ("j9", "9")], "job_id string, runtime_job_id string")
    assert {r.job_id: r.status for r in attach_status(jobs, first).collect()} == {"j1": "RUNNING", "j2": None, "j9": None}
    feed = spark.createDataFrame([("1", 1, "A"), ("1", 2, "B")], "runtime_job_id string, ts int, status string")
    assert latest_status(feed).first().status == "B"
