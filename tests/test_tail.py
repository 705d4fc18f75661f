"""Growing log files: only new bytes, cut into ranges at line ends, in batch and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import tail
from tidewatch.streaming import jobs as streaming

LOGS, CURSORS = "job_id bigint, path string", "job_id bigint, log_cursor bigint"


def content(seed, lines):
    rnd = random.Random(seed)
    return "".join("".join(rnd.choices("abé漢 ", k=rnd.randint(0, 40))) + "\n" for _ in range(lines)).encode()


@pytest.mark.parametrize("step", [1, 7, 64, 10_000])
def test_ranges_put_together_are_the_text(tmp_path, step):
    for data in (content(1, 30), b"", b"\n\n\n", b"no end", content(2, 5) + b"rest", b"x" * 500 + b"\n" + b"y" * 300):
        path = tmp_path / "log"
        path.write_bytes(data)
        for first in {0, len(data) // 2}:
            parts = [tail.read_range(str(path), first, a, b, len(data)) for a, b in tail.ranges_of(first, len(data), step)]
            told = [p for p in parts if p[1]]
            assert "".join(text for _, text in told) == data[first:].decode("utf-8", "replace")
            assert all(text.endswith("\n") for _, text in told[:-1])
            at = first
            for begin, text in told:
                assert begin == at
                at += len(data[first:].decode("utf-8", "replace").encode()) if len(told) == 1 else len(text.encode())


def test_a_line_end_is_found_beyond_a_block(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 16)
    path = tmp_path / "log"
    path.write_bytes(b"a" * 100 + b"\n" + b"b" * 100 + b"\n")
    assert [tail.read_range(str(path), 0, a, b, 202)[1] for a, b in tail.ranges_of(0, 202, 50)] == ["a" * 100 + "\n", "", "b" * 100 + "\n", "", ""]


def test_new_text_by_tables(spark, tmp_path):
    data = {1: content(3, 400), 2: "é\nend".encode(), 3: b"short", 4: b"", 6: b"whole\n"}
    for job, text in data.items():
        (tmp_path / f"{job}.log").write_bytes(text)
    logs = spark.createDataFrame([(j, str(tmp_path / f"{j}.log")) for j in (1, 2, 3, 4, 5, 6)] + [(7, None)], LOGS)
    cursors = spark.createDataFrame([(1, 2001), (2, 1), (3, 99), (6, None), (8, 5)], CURSORS)
    read = tail.new_text(logs, cursors, 1000)
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    rows = sorted(read.collect(), key=lambda r: (r["job_id"], r["start"]))
    got = {j: "".join(r["text"] for r in rows if r["job_id"] == j) for j in {r["job_id"] for r in rows}}
    assert got == {1: data[1][2001:].decode("utf-8", "replace"), 2: data[2][1:].decode("utf-8", "replace"), 6: "whole\n"}
    assert {r["job_id"]: r["log_cursor"] for r in rows} == {1: len(data[1]), 2: 6, 6: 6}
    assert len([r for r in rows if r["job_id"] == 1]) > 3
    after = {r["job_id"]: r["log_cursor"] for r in tail.next_cursors(logs, cursors).collect()}
    assert after == {1: len(data[1]), 2: 6, 3: 99, 4: 0, 5: 0, 6: 6, 7: 0}
    assert tail.new_text(logs.limit(0), cursors).collect() == []


def test_only_new_bytes_are_read(spark, tmp_path):
    """What lies before the cursor may be anything, even no text."""
    (tmp_path / "log").write_bytes(b"\xff\xfe" * 1000 + b"\nfresh\n")
    logs = spark.createDataFrame([(1, f"file://{tmp_path}/log")], LOGS)
    (row,) = tail.new_text(logs, spark.createDataFrame([(1, 2001)], CURSORS)).collect()
    assert row["text"] == "fresh\n" and row["start"] == 2001


def test_source_in_batch_and_as_a_stream(spark, tmp_path):
    tail.register(spark)
    logs, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    logs.mkdir()
    (logs / "a.log").write_bytes(content(5, 50))
    (logs / "b.log").write_bytes(b"one\n")
    (logs / "c.txt").write_bytes(b"not a log\n")

    def text_of(frame):
        rows = sorted(frame.collect(), key=lambda r: (r["path"], r["start"]))
        return {name: "".join(r["text"] for r in rows if r["path"].endswith(name)) for name in ("a.log", "b.log", "c.txt")}

    batch = spark.read.format("log_tail").option("suffix", ".log").option("rangeBytes", 100).load(str(logs))
    assert text_of(batch) == {"a.log": content(5, 50).decode(), "b.log": "one\n", "c.txt": ""}

    def stream():
        return spark.readStream.format("log_tail").option("suffix", ".log").option("rangeBytes", 100).load(str(logs))

    streaming.drain(spark, stream(), "tail", out, check)
    with open(logs / "b.log", "ab") as f:
        f.write("zwei ü\n".encode())
    (logs / "d.log").write_bytes(b"late file\n")
    done = streaming.drain(spark, stream(), "tail", out, check)
    assert text_of(done) == {"a.log": content(5, 50).decode(), "b.log": "one\nzwei ü\n", "c.txt": ""}
    assert sorted(r["text"] for r in done.filter(~F.col("path").endswith("a.log")).collect()) == ["late file\n", "one\n", "zwei ü\n"]
