"""Job records on disk, registry changes and reports."""

import json

from pyspark.sql import functions as F

from tidewatch.operators import reports
from tidewatch.sources import registry
from tidewatch.sources.logs import log_increments, read_log_files
from tidewatch.sources.sinks import write_messages


def record(job_id, key="definition", final=None, **runtime):
    body = {
        "name": job_id,
        "log_path": "l_%j.log",
        "metadata": {"team": "x"},
        "log_events": [
            {"name": "a", "pattern": "OOM", "match_once": True, "action": {"class_name": "RestartAction"}},
            {"name": "b", "pattern": "quiet"},
            {"name": "c", "pattern": "DONE", "action": {"class_name": "FinishAction"}},
        ],
        "state_events": [{"name": "s", "transition": [None, "RUNNING"], "action": {"class_name": "LogAction"}}],
        "start_condition": {"class_name": "FileExistsCondition", "path": "x"},
    }
    return {"job_id": job_id, key: body, "runtime": {"attempts": 1, "final_state": final, **runtime}, "schema_version": 1}


def store(tmp_path):
    for name, body in {
        "job1": record("job1"),
        "job2": record("job2", "registration"),
        "job3": record("job3", final="finished"),
    }.items():
        (tmp_path / f"{name}.job.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "bad.job.json").write_text("not valid json")
    (tmp_path / "note.json").write_text("{}")
    return str(tmp_path)


def test_scan(spark, tmp_path):
    records = registry.read_records(spark, store(tmp_path))
    assert {r.job_id for r in registry.scan(records).collect()} == {"job1", "job2"}
    assert {r.job_id for r in registry.scan(records, include_finished=True).collect()} == {"job1", "job2", "job3"}
    assert registry.quarantine(records).count() == 1
    flat = registry.flatten(registry.scan(records))
    assert {r.name for r in flat.collect()} == {"job1", "job2"}
    assert registry.lookup(flat, "job1").count() == 1 and registry.lookup(flat, "job9").count() == 0


def test_rules_as_rows(spark, tmp_path):
    flat = registry.flatten(registry.scan(registry.read_records(spark, store(tmp_path))))
    rules = registry.log_rules(flat).filter("job_id = 'job2'").orderBy("rule_idx").collect()
    assert [(r.rule_idx, r.name, r.action.class_name) for r in rules] == [(0, "a", "RestartAction"), (2, "c", "FinishAction")]
    states = registry.state_rules(flat).filter("job_id = 'job1'").collect()
    assert [(r.old, r.new) for r in states] == [(None, "RUNNING")]


def test_written_registry_reads_open_jobs_only(spark, tmp_path):
    flat = registry.flatten(registry.scan(registry.read_records(spark, store(tmp_path)), include_finished=True))
    registry.write_registry(flat, str(tmp_path / "snap"))
    back = registry.read_registry(spark, str(tmp_path / "snap"))
    assert {r.job_id for r in back.collect()} == {"job1", "job2"}
    assert "PartitionFilters: [isnotnull(shelf" in back._jdf.queryExecution().executedPlan().toString()
    assert registry.read_registry(spark, str(tmp_path / "snap"), include_finished=True).count() == 3


def test_upsert_and_submit(spark):
    jobs = spark.createDataFrame([("a", 1, 0, "old"), ("b", 1, 0, "old")], "job_id string, ts int, seq int, name string")
    new = spark.createDataFrame([("a", 2, 0, None), ("c", 1, 0, "new")], "job_id string, ts int, seq int, name string")
    got = {r.job_id: r.name for r in registry.submit(jobs, new).collect()}
    assert got == {"a": None, "b": "old", "c": "new"}


def test_remove_and_finish(spark):
    jobs = spark.createDataFrame([("a", None, None), ("b", "finished", 5)], "job_id string, final_state string, end_ts int")
    assert [r.job_id for r in registry.remove(jobs, jobs.filter("job_id = 'a'")).collect()] == ["b"]
    done = spark.createDataFrame([("a", "cancelled", 7), ("b", "cancelled", 8), ("z", "cancelled", 9)], "job_id string, state string, at int")
    got = {r.job_id: (r.final_state, r.end_ts) for r in registry.mark_finished(jobs, done).collect()}
    assert got == {"a": ("cancelled", 7), "b": ("finished", 5)}


def test_arrays(spark):
    data = [("sweep", 3, 4, False, None), ("solo", 1, 0, False, None), ("none", None, 0, True, "r9")]
    jobs = spark.createDataFrame(data, "job_id string, array_len int, attempts int, submitted boolean, runtime_job_id string")
    ids = F.array(F.lit("p"), F.lit("q"), F.lit("r"))
    got = {tuple(r)[:1] + tuple(r)[2:] for r in registry.expand_arrays(jobs, ids).collect()}
    assert got == {
        ("sweep_0", 5, True, "p", 0), ("sweep_1", 5, True, "q", 1), ("sweep_2", 5, True, "r", 2),
        ("solo", 0, False, None, None), ("none", 0, True, "r9", None),
    }
    fewer = registry.expand_arrays(jobs, F.array(F.lit("p"))).collect()
    assert {r.job_id for r in fewer} == {"sweep_0", "solo", "none"}
    failed = registry.expand_arrays(jobs, F.array().cast("array<string>")).collect()
    assert {(r.job_id, r.attempts) for r in failed} == {("sweep", 4), ("solo", 0), ("none", 0)}
    lengths = spark.createDataFrame([([["a"], ["b"]],), ([],), (None,)], "x array<array<string>>")
    assert [r[0] for r in lengths.select(registry.array_len(F.col("x"))).collect()] == [2, 1, 1]


def test_cleanup(spark):
    jobs = spark.createDataFrame(
        [("a", "COMPLETED", None), ("b", "RUNNING", None), ("c", "COMPLETED", "finished"), ("d", None, None)],
        "job_id string, last_status string, final_state string",
    )

    def removed(**options):
        gone, kept = registry.cleanup(jobs, **options)
        assert gone.count() + kept.count() == 4
        return {r.job_id for r in gone.collect()}

    assert removed(done_only=True) == {"a"}
    assert removed(done_only=True, scope="all") == {"a", "c"}
    assert removed() == {"a", "b", "d"}
    assert removed(scope="all") == {"a", "b", "c", "d"}


def test_cursor_moves_without_a_match(spark):
    logs = spark.createDataFrame([("a", "MISS\n"), ("b", "abcdef"), ("c", "ab"), ("d", "äöü"), ("e", "äöü")], "job_id string, text string")
    cursors = spark.createDataFrame([("b", 4), ("c", 9), ("d", 2), ("e", 3)], "job_id string, log_cursor long")
    got = {r.job_id: (r.new_text, r.log_cursor) for r in log_increments(logs, cursors).collect()}
    assert got == {"a": ("MISS\n", 5), "b": ("ef", 6), "c": ("", 9), "d": ("öü", 6), "e": ("\ufffdü", 6)}


def test_log_files_with_broken_bytes(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"ok \xff end")
    assert read_log_files(spark, str(tmp_path)).first().text == "ok � end"


def test_rollup(spark):
    data = [("j", "e", 1, 0, "v0"), ("j", "e", 3, 0, None), ("j", "e", 2, 0, "val")]
    events = spark.createDataFrame(data, "job string, event string, ts int, seq int, k string")
    row = reports.event_rollup(events, ["job", "event"], payload={"k": "key"}).first()
    assert (row["count"], row.first_seen_ts, row.last_seen_ts, row.key) == (3, 1, 3, "val")
    assert reports.event_history(events, ["job"], F.col("k")).count() == 2


def test_reports(spark):
    columns = "job_id string, name string, attempts int, submitted boolean, runtime_job_id string, last_status string, log_path string, final_state string"
    jobs = spark.createDataFrame([("a", "n", 1, True, "1", "RUNNING", "l", None), ("b", None, 0, False, None, None, "l", None), ("c", "n", 1, True, "3", None, "l", "finished")], columns)
    lines = {r.job_id: r.line for r in reports.status_report(jobs, as_text=True).collect()}
    assert lines == {"a": "- a n status=RUNNING attempts=1 submitted=True", "b": "- b  status=None attempts=0 submitted=False"}
    made = {r.job_id: json.loads(r.line) for r in reports.status_report(jobs, as_json=True).collect()}
    assert made["b"]["runtime_job_id"] is None and set(made["a"]) == set(reports.REPORT_COLUMNS)
    status = spark.createDataFrame([("1", "RUNNING")], "runtime_job_id string, status string")
    states = {r.job_id: r.state for r in reports.poll_snapshot(jobs, status, F.lit(False)).collect()}
    assert states == {"a": "RUNNING", "b": "pending"}


def test_message_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "LogAction", "info", "m"), (1, "a", "FinishAction", "info", "r")], "ts int, job_id string, action string, level string, message string")
    write_messages(rows, str(tmp_path / "m"))
    assert [r.message for r in spark.read.parquet(str(tmp_path / "m")).collect()] == ["m"]
