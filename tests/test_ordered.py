"""Ordered operators and folds against plain Python, with a hot key cut into many parts."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ordered
from tidewatch.operators.cooldown import cooldown_firings
from tidewatch.operators.transitions import (
    inactivity_gaps,
    open_gaps,
    status_at_chunk,
    status_changes,
    status_changes_with_missing,
)

EPOCH = datetime.datetime(2024, 1, 1)
# Small enough that the hot key below is cut and the others are not.
LIMIT = 50


def at(seconds):
    return EPOCH + datetime.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def rows():
    """A third of the rows belong to one key, bunched in time and with many ties."""
    rng = random.Random(7)
    out = []
    for i in range(900):
        hot = i % 3 == 0
        key = "hot" if hot else f"k{rng.randrange(40)}"
        when = int(rng.choice([1000, 1001, rng.randrange(5000)])) if hot else rng.randrange(5000)
        out.append((key, at(when), i, rng.choice(["a", "b", None]), rng.randrange(3)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, id long, status string, v int")


def by_key(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[row[0]].append(row)
    return groups


def test_only_hot_keys_are_cut(frame):
    plain, crowded = ordered.split_hot(frame, ["key"], ["ts", "id"], LIMIT)
    parts = crowded.groupBy("key", "__part").count().collect()
    assert {r.key for r in parts} == {"hot"} and len(parts) > 3 and sum(r["count"] for r in parts) == 300
    assert plain.filter("key = 'hot'").count() == 0 and plain.count() == 600
    assert ordered.split_hot(frame, ["key"], ["ts", "id"], 1000)[1] is None


def test_a_burst_and_an_instant_are_cut(spark):
    """Nearly all rows of the key in one second of a year, half of them in one instant."""
    data = [("k", at(0), 0), ("k", at(31_000_000), 1)]
    data += [("k", EPOCH + datetime.timedelta(seconds=77, microseconds=0 if i % 2 else i), i) for i in range(2, 2000)]
    frame = spark.createDataFrame(data, "key string, ts timestamp_ntz, id long")
    _, crowded = ordered.split_hot(frame, ["key"], ["ts", "id"], 100)
    sizes = [r["count"] for r in crowded.groupBy("__part").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 200
    got = ordered.previous(frame, ["key"], ["ts", "id"], {"id": "old"}, 100).collect()
    line = sorted(data, key=lambda r: r[1:])
    assert {r.id: r.old for r in got} == {b[2]: a[2] for a, b in zip(line, line[1:])} | {0: None}


def test_a_hot_null_key(spark):
    frame = spark.createDataFrame([(None if i < 90 else "k", i) for i in range(120)], "key string, id long")
    got = ordered.running_sum(frame, ["key"], ["id"], F.lit(1), "n", limit=40).collect()
    assert {r.id: r.n for r in got} == {i: i + 1 if i < 90 else i - 89 for i in range(120)}


@pytest.mark.parametrize("limit", [LIMIT, ordered.DEFAULT_LIMIT, 1])
def test_previous(frame, rows, limit):
    got = ordered.previous(frame, ["key"], ["ts", "id"], {"status": "old", "id": "old_id"}, limit).collect()
    want = {}
    for group in by_key(rows).values():
        for before, row in zip([None, *group], group):
            want[row[2]] = (None, None, False) if before is None else (before[3], before[2], True)
    assert {r.id: (r.old, r.old_id, r.has_previous) for r in got} == want


@pytest.mark.parametrize("limit", [LIMIT, ordered.DEFAULT_LIMIT])
@pytest.mark.parametrize("current", [True, False])
def test_running_sum(frame, rows, limit, current):
    got = ordered.running_sum(frame, ["key"], ["ts", "id"], F.col("v"), "total", current, limit).collect()
    want = {}
    for group in by_key(rows).values():
        total = 0
        for row in group:
            want[row[2]] = total + (row[4] if current else 0)
            total += row[4]
    assert {r.id: r.total for r in got} == want


@pytest.mark.parametrize("limit", [LIMIT, ordered.DEFAULT_LIMIT])
def test_last_known(frame, rows, limit):
    got = ordered.last_known(frame, ["key"], ["ts", "id"], F.col("status"), "known", limit).collect()
    want = {}
    for group in by_key(rows).values():
        known = None
        for row in group:
            known = row[3] or known
            want[row[2]] = known
    assert {r.id: r.known for r in got} == want


@pytest.mark.parametrize("limit", [LIMIT, ordered.DEFAULT_LIMIT])
def test_status_changes(frame, rows, limit):
    got = status_changes(frame.drop("v"), "key", ["ts", "id"], limit).collect()
    want = set()
    for key, group in by_key(rows).items():
        old = None
        for row in group:
            if row[3] != old:
                want.add((key, row[2], old, row[3], f"{old} -> {row[3]}"))
            old = row[3]
    assert {(r.key, r.id, r.old_status, r.new_status, r.transition) for r in got} == want


def test_first_status_is_a_change_unless_null(spark):
    feed = spark.createDataFrame([("a", at(0), "RUNNING"), ("b", at(0), None)], "runtime_job_id string, ts timestamp_ntz, status string")
    assert [(r.runtime_job_id, r.transition) for r in status_changes(feed).collect()] == [("a", "None -> RUNNING")]


def test_missing_polls_are_changes(spark):
    rng = random.Random(3)
    polls = [(at(i),) for i in range(30)]
    seen = {(k, i): rng.choice("xy") for k in range(6) for i in range(30) if rng.random() < 0.6}
    feed = spark.createDataFrame([(str(k), at(i), s) for (k, i), s in seen.items()], "runtime_job_id string, ts timestamp_ntz, status string")
    got = status_changes_with_missing(feed, spark.createDataFrame(polls, "ts timestamp_ntz"), limit=5).collect()
    want = set()
    for k in range(6):
        old = None
        for i in range(30):
            new = seen.get((k, i))
            if new != old:
                want.add((str(k), at(i), old, new))
            old = new
    assert {(r.runtime_job_id, r.ts, r.old_status, r.new_status) for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("limit", [LIMIT, ordered.DEFAULT_LIMIT])
def test_status_at_chunk(frame, rows, limit):
    line = frame.select(F.col("key").alias("job_id"), "ts", F.col("id").alias("seq"), "status", "v")
    chunks, feed = line.filter("v = 0"), line.filter("v > 0")
    got = status_at_chunk(chunks, feed, limit=limit).collect()
    want = {}
    for group in by_key(rows).values():
        known = None
        for row in sorted(group, key=lambda r: (r[1], r[4] == 0, r[2])):
            if row[4]:
                known = row[3]
            else:
                want[row[2]] = known
    assert {r.seq: r.status for r in got} == want


def test_gaps(spark):
    chunks = spark.createDataFrame([("a", at(0)), ("a", at(10)), ("a", at(75)), ("b", at(5))], "job_id string, ts timestamp_ntz")
    gaps = inactivity_gaps(chunks, 60).collect()
    assert [(r.job_id, r.silent_from, r.silent_until, r.gap_us) for r in gaps] == [("a", at(10), at(75), 65_000_000)]
    open_now = open_gaps(chunks, 60, F.lit(at(100)).cast("timestamp_ntz")).collect()
    assert [(r.job_id, r.gap_us) for r in open_now] == [("b", 95_000_000)]


@pytest.mark.parametrize("partitions", [1, 4, 23])
@pytest.mark.parametrize("seconds", [0.0, 1.5, 60.0, 100000.0])
def test_cooldown(frame, rows, partitions, seconds):
    got = cooldown_firings(frame, "key", ["ts", "id"], seconds, partitions=partitions).collect()
    want = {}
    for group in by_key(rows).values():
        last = None
        for row in group:
            fires = last is None or (row[1] - last).total_seconds() >= seconds
            want[row[2]] = fires
            last = row[1] if fires else last
    assert {r.id: r.fired for r in got} == want
    assert len(got) == len(rows)
