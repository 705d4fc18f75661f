"""Registry snapshots that a stream keeps, and late rows as a table."""

import datetime

from tidewatch.streaming import snapshots

WRITES = "job_id string, ts long, seq long, status string"
EPOCH = datetime.datetime(2024, 1, 1)


def state(spark, path):
    return {r["job_id"]: (r["ts"], r["seq"], r["status"]) for r in snapshots.read_snapshot(spark, path, WRITES).collect()}


def test_last_write_stays_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    assert state(spark, path) == {}
    snapshots.merge_batch(spark.createDataFrame([("a", 5, 0, "x"), ("a", 5, 1, "y"), ("b", 1, 0, "x"), (None, 1, 0, "n")], WRITES), 0, path, buckets=4)
    first = {"a": (5, 1, "y"), "b": (1, 0, "x"), None: (1, 0, "n")}
    assert state(spark, path) == first
    snapshots.merge_batch(spark.createDataFrame([("a", 9, 0, "again")], WRITES), 0, path, buckets=4)
    assert state(spark, path) == first
    snapshots.merge_batch(spark.createDataFrame([("a", 4, 9, "old"), ("c", 2, 0, "x")], WRITES), 1, path, buckets=4)
    assert state(spark, path) == first | {"c": (2, 0, "x")}
    snapshots.merge_batch(spark.createDataFrame([], WRITES), 2, path, buckets=4)
    assert state(spark, path) == first | {"c": (2, 0, "x")}


def test_a_batch_that_failed_is_written_over(spark, tmp_path):
    """Its data lie there without a manifest, so nobody reads them."""
    path = str(tmp_path / "s")
    snapshots.merge_batch(spark.createDataFrame([("a", 1, 0, "x")], WRITES), 0, path, buckets=2)
    spark.createDataFrame([("a", 99, 0, "lost")], WRITES).write.parquet(f"{path}/data/batch=1/bucket=0")
    assert state(spark, path) == {"a": (1, 0, "x")}
    snapshots.merge_batch(spark.createDataFrame([("a", 2, 0, "y"), ("b", 1, 0, "z")], WRITES), 1, path, buckets=2)
    assert state(spark, path) == {"a": (2, 0, "y"), "b": (1, 0, "z")}


def test_late_rows(spark, tmp_path):
    path, shape = str(tmp_path / "late"), "id long, ts timestamp_ntz"
    at = lambda s: EPOCH + datetime.timedelta(seconds=s)
    batches = [[(1, at(0)), (2, at(100))], [(3, at(89)), (4, at(90)), (5, at(91))], [(6, at(95)), (7, at(50))], []]
    for n, rows in enumerate(batches):
        for _ in range(2):  # a batch that is run again gives the same
            snapshots.divert_late(spark.createDataFrame(rows, shape), n, path, "ts", "10 seconds")
    late = snapshots.read_late(spark, path, spark.createDataFrame([], shape).schema).collect()
    assert sorted((r["id"], r["batch"]) for r in late) == [(3, 1), (4, 1), (7, 2)]
