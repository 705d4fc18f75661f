"""Streams over several files against the batch plans, with a stop in between."""

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewatch.operators import conditions as c
from tidewatch.operators import lifecycle as lc
from tidewatch.operators.actions import Action
from tidewatch.operators.matching import match_triggers
from tidewatch.operators.rules import LogRule
from tidewatch.operators.transitions import status_changes
from tidewatch.schemas import LOG_CHUNKS
from tidewatch.sources.logs import stream_chunks
from tidewatch.streaming import jobs as streaming

EPOCH = datetime.datetime(2024, 1, 1)
SPEC = lc.Spec(
    log_rules=[
        LogRule("oom", "OOM", action=Action("RestartAction"), condition=c.MaxAttempts(max_attempts=4)),
        LogRule("tick", "tick", action=Action("LogAction"), match_once=False, condition=c.Cooldown(cooldown_seconds=3)),
        LogRule("slow", "slow", action=Action("LogAction"), condition=c.Timeout(timeout_seconds=20, persistent_fail=True)),
        LogRule("done", "DONE", action=Action("FinishAction")),
    ]
)


def at(seconds):
    return EPOCH + datetime.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def chunks():
    rng = random.Random(11)
    out = []
    for job in range(12):
        for seq in range(30):
            words = rng.choices(["OOM", "tick", "slow", "x", "DONE"], [1, 3, 3, 5, 0.15], k=3)
            out.append((f"j{job}", seq, at(seq * rng.choice([1, 1, 2])), " ".join(words)))
    return out


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def decisions(frame):
    return {
        (r.job_id, r.chunk_seq, r.rule_idx, r.match_seq): (r.evaluated, r.fired, r.attempts, r.outcome)
        for r in frame.collect()
    }


def test_stream_equals_batch_over_a_restart(spark, tmp_path, chunks):
    """Three files, the stream stopped and started again before the last."""
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def stream():
        text = stream_chunks(spark, src, maxFilesPerTrigger="1")
        hits = match_triggers(text, SPEC.log_rules, payload=False)
        return streaming.job_decisions(lc.trigger_rows(hits, SPEC), SPEC, late="1 minute")

    for low, high in ((0, 10), (10, 20)):
        write(spark, [r for r in chunks if low <= r[1] < high], LOG_CHUNKS, src)
    streaming.drain(spark, stream(), "jobs", out, check)
    write(spark, [r for r in chunks if r[1] >= 20], LOG_CHUNKS, src)
    # A last row of another job moves the watermark past all others.
    write(spark, [("end", 0, at(9000), "tick")], LOG_CHUNKS, src)
    got = decisions(streaming.drain(spark, stream(), "jobs", out, check))

    hits = match_triggers(spark.createDataFrame(chunks, LOG_CHUNKS), SPEC.log_rules, payload=False)
    want = decisions(lc.replay_fold(lc.trigger_rows(hits, SPEC), SPEC))
    got = {k: v for k, v in got.items() if k[0] != "end"}
    assert got == want
    assert {v[3] for v in want.values()} == {None, "finished"} and max(v[2] for v in want.values()) == 4


def test_transitions_over_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"k{i % 5}", 1_000_000 + i * 1000, i, rng.choice(["a", "b", None])) for i in range(120)]
    schema = "runtime_job_id string, us long, seq long, status string"
    src = str(tmp_path / "in")
    # The files' times interleave, by up to 50 ms.
    mixed = sorted(rows, key=lambda r: r[1] + rng.randrange(50_000))
    for part in range(3):
        write(spark, mixed[part * 40 : part * 40 + 40], schema, src)
    write(spark, [("end", 10**9, 0, None)], schema, src)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = streaming.drain(spark, streaming.stream_transitions(feed, "100 milliseconds"), "t")
    want = status_changes(spark.createDataFrame(rows, schema), order=["us", "seq"])
    key = ("runtime_job_id", "seq", "old_status", "new_status", "transition")
    assert {tuple(r[k] for k in key) for r in got.collect()} == {tuple(r[k] for k in key) for r in want.collect()}


def test_timers_fire_without_input(spark, tmp_path):
    """Job a falls silent; rows of others move the watermark past its time."""
    src = str(tmp_path / "in")
    write(spark, [("a", at(0)), ("b", at(10))], "job_id string, ts timestamp_ntz", src)
    write(spark, [("b", at(100)), ("c", at(4000))], "job_id string, ts timestamp_ntz", src)
    write(spark, [("c", at(4001))], "job_id string, ts timestamp_ntz", src)

    def feed():
        return spark.readStream.schema("job_id string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(src)

    done = streaming.drain(spark, streaming.stream_timeouts(feed(), "job_id", 60, late="1 second"), "to")
    base = int(EPOCH.replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    got = {r.key: (r.since_us - base, r.until_us - base) for r in done.collect()}
    assert got["a"] == (0, 60_000_000) and got["b"] == (10_000_000, 70_000_000) and "c" not in got

    quiet = streaming.drain(spark, streaming.stream_inactivity(feed(), "job_id", 60, late="1 second"), "quiet")
    found = {(r.key, r.since_us - base, None if r.until_us is None else r.until_us - base) for r in quiet.collect()}
    assert ("a", 0, None) in found and ("b", 100_000_000, None) in found
    assert ("b", 10_000_000, 100_000_000) in found


def test_silences_do_not_depend_on_the_files(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "job_id string, ts timestamp_ntz"
    write(spark, [("a", at(0)), ("a", at(600))], schema, src)
    write(spark, [("a", at(300)), ("a", at(900))], schema, src)
    write(spark, [("z", at(90_000))], schema, src)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    quiet = streaming.drain(spark, streaming.stream_inactivity(feed, "job_id", 400, late="1000 seconds"), "quiet")
    base = int(EPOCH.replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    assert [(r.key, r.since_us - base, r.until_us) for r in quiet.collect()] == [("a", 900_000_000, None)]


def test_late_rows_are_counted():
    progress = [{"stateOperators": [{"numRowsDroppedByWatermark": 2}]}, {"stateOperators": []}, {}]
    assert streaming.late_rows(progress) == 2


def test_a_stream_reads_a_file_and_a_table_of_several_files(spark, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many.parquet")
    spark.range(40).repartition(1).write.parquet(one)
    spark.range(40).repartition(5).write.parquet(many)
    file = next(str(p) for p in (tmp_path / "one").glob("part-*.parquet"))
    for table in (file, many):
        assert streaming.drain(spark, streaming.read_stream(spark, table), "ids").count() == 40


def test_a_mark_ends_a_feed(spark, tmp_path):
    """No row of another key is needed for the last rows to come out, and the same whatever the files."""
    rng = random.Random(5)
    rows = [(f"k{i % 4}", 1_000_000 * i, i, rng.choice(["a", "b", None])) for i in range(60)]
    schema = "runtime_job_id string, us long, seq long, status string"
    want = {(r.runtime_job_id, r.seq, r.old_status, r.new_status) for r in status_changes(spark.createDataFrame(rows, schema), order=["us", "seq"]).collect()}
    for files in (1, 5):
        src = str(tmp_path / f"in{files}")
        for part in range(files):
            write(spark, rows[part::files], schema, src)
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        marks = streaming.marks_folder(spark)
        done = streaming.drain(spark, streaming.stream_transitions(feed, "10 minutes", marks), "t", marks=marks, late="10 minutes")
        assert {(r.runtime_job_id, r.seq, r.old_status, r.new_status) for r in done.collect()} == want


def test_an_empty_feed_has_no_mark(spark, tmp_path):
    schema, src = "job_id string, ts timestamp_ntz", str(tmp_path / "in")
    write(spark, [], schema, src)
    marks = streaming.marks_folder(spark)
    feed = spark.readStream.schema(schema).parquet(src)
    assert streaming.drain(spark, streaming.stream_timeouts(feed, "job_id", 60, marks=marks), "none", marks=marks).collect() == []


def test_idle_keys_are_forgotten(spark, tmp_path):
    """A status that comes back after a long silence is a change from nothing; a timeout starts anew."""
    schema, src = "runtime_job_id string, us long, seq long, status string", str(tmp_path / "in")
    second = 1_000_000
    write(spark, [("k", 10 * second, 1, "a"), ("k", 20 * second, 2, "a"), ("k", 500 * second, 3, "a"), ("k", 505 * second, 4, "b")], schema, src)
    feed = spark.readStream.schema(schema).parquet(src)
    marks = streaming.marks_folder(spark)
    done = streaming.drain(spark, streaming.stream_transitions(feed, "1 second", marks, forget=100), "t", marks=marks, late="1 second").collect()
    assert sorted((r.seq, r.old_status, r.new_status) for r in done) == [(1, None, "a"), (3, None, "a"), (4, "a", "b")]

    src = str(tmp_path / "timed")
    for at_ in ([0, 5], [400], [401], [900], [1500]):
        write(spark, [("a", at(x)) for x in at_], "job_id string, ts timestamp_ntz", src)
    feed = spark.readStream.schema("job_id string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(src)
    marks = streaming.marks_folder(spark)
    told = streaming.drain(spark, streaming.stream_timeouts(feed, "job_id", 60, late="1 second", marks=marks, forget=30), "to", marks=marks, late="1 second")
    base = int(EPOCH.replace(tzinfo=datetime.timezone.utc).timestamp())
    assert sorted(r.since_us // second - base for r in told.collect()) == [0, 400, 900]


def test_a_stream_goes_on_from_the_end_of_a_batch(spark, tmp_path, chunks):
    hits = match_triggers(spark.createDataFrame(chunks, LOG_CHUNKS), SPEC.log_rules, payload=False)
    rows = lc.trigger_rows(hits, SPEC)
    want = decisions(lc.replay_fold(rows, SPEC).filter("evaluated"))
    half = F.col("chunk_seq") < 14
    first = lc.replay_fold(rows.filter(half), SPEC).filter("evaluated")
    states = lc.end_states(first, SPEC)
    second = lc.replay_fold(rows.filter(~half), SPEC, initial=states).filter("evaluated")
    assert decisions(first) | decisions(second) == want

    src = str(tmp_path / "in")
    write(spark, [r for r in chunks if r[1] >= 14], LOG_CHUNKS, src)
    late_rows = lc.trigger_rows(match_triggers(stream_chunks(spark, src), SPEC.log_rules, payload=False), SPEC)
    marks = streaming.marks_folder(spark)
    stream = streaming.job_decisions(late_rows, SPEC, "1 minute", marks, initial=states)
    got = decisions(streaming.drain(spark, stream, "jobs", marks=marks, late="1 minute").filter("evaluated"))
    assert decisions(first) | got == want


def test_end_states_of_two_runs_are_those_of_one(spark, chunks):
    rows = lc.trigger_rows(match_triggers(spark.createDataFrame(chunks, LOG_CHUNKS), SPEC.log_rules, payload=False), SPEC)
    whole = lc.end_states(lc.replay_fold(rows, SPEC), SPEC)
    half = F.col("chunk_seq") < 9
    first = lc.end_states(lc.replay_fold(rows.filter(half), SPEC), SPEC)
    second = lc.end_states(lc.replay_fold(rows.filter(~half), SPEC, initial=first), SPEC, earlier=first)
    assert sorted(map(str, whole.collect())) == sorted(map(str, second.collect()))
    assert any(m["latch"] is False for r in whole.collect() for m in r["memory"])


class _Held:
    """A list in the state store that counts what is put into it and read from it."""

    def __init__(self):
        self.values, self.reads = [], 0

    def get(self):
        self.reads += 1
        return iter(list(self.values))

    def appendValue(self, value):
        self.values.append(value)

    def appendList(self, values):
        self.values += values

    def clear(self):
        self.values = []


class _Handle:
    def __init__(self):
        self.pending, self.timers, self.state = _Held(), set(), None

    def getListState(self, name, schema):
        return self.pending

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.state is not None

    def get(self):
        return self.state

    def update(self, state):
        self.state = state

    def listTimers(self):
        return iter(set(self.timers))

    def registerTimer(self, at_):
        self.timers.add(at_)

    def deleteTimer(self, at_):
        self.timers.remove(at_)


class _Clock:
    def __init__(self, mark):
        self.getCurrentWatermarkInMs = lambda: mark


def test_rows_of_a_micro_batch_are_held_as_one_value():
    """Rows that wait are written as one value a key and not read back before their time; the earliest sets the timer."""
    row, handle = Row("runtime_job_id", "us", "seq", "status", "at"), _Handle()
    processor = streaming.TransitionProcessor()
    processor.init(handle)
    for start in (500, 100, 900):
        came = [row("a", (start + i) * 1000, start + i, "ab"[i // 2 % 2], None) for i in range(40)]
        assert not list(processor.handleInputRows(("a",), iter(came), _Clock(50)))
    assert len(handle.pending.values) == 3 and handle.pending.reads == 0
    assert min(handle.timers) == 100
    told = list(processor.handleExpiredTimer(("a",), _Clock(519), None))
    assert [r.seq for r in told] == [*range(100, 140, 2), *range(500, 520, 2)]
    assert len(handle.pending.values) == 1 and handle.timers == {520}
    rest = list(processor.handleInputRows(("a",), iter([row("a", 521_500, 0, "c", None)]), _Clock(2000)))
    assert [r.seq for r in rest] == [520, 0, 522, *range(524, 540, 2), *range(900, 940, 2)]
    assert not handle.pending.values and not handle.timers
