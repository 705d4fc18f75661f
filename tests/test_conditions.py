"""Conditions, latches and markers on small cases."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import conditions as c
from tidewatch.sources.markers import read_markers

EPOCH = datetime.datetime(2024, 1, 1)


def rows(spark, *extra, schema=""):
    data = [(i, EPOCH + datetime.timedelta(seconds=i), *e) for i, e in enumerate(extra)]
    return spark.createDataFrame(data, "id int, ts timestamp_ntz, " + schema)


def judged(frame, condition, **options):
    done = c.evaluate(frame.withColumn("job", F.lit("j")), condition, ["job"], ["ts", "id"], **options)
    return [(r.passed, r.message) for r in done.orderBy("id").collect()]


def test_no_condition_passes(spark):
    assert judged(rows(spark, (1,), schema="x int"), None) == [(True, "")]


def test_timeout_ends_on_the_second(spark):
    frame = spark.createDataFrame([(i, EPOCH + datetime.timedelta(seconds=s)) for i, s in enumerate((0, 4, 5, 6))], "id int, ts timestamp_ntz")
    got = judged(frame, c.Timeout(timeout_seconds=5, message="late 100%"))
    assert [p for p, _ in got] == [True, True, False, False]
    assert got[1][1] == "late 100% (1.0s remaining)" and got[2][1] == "late 100%"


def test_attempts(spark):
    got = judged(rows(spark, (2,), (3,), schema="n int"), c.MaxAttempts(max_attempts=3), attempts="n")
    assert got == [(True, ""), (False, "attempts 3 >= limit 3")]


def test_metadata(spark):
    frame = rows(spark, ({"status": "ready"},), ({"status": "error"},), ({"other": "x"},), schema="md map<string,string>")
    within = c.Metadata(key="status", within=("ready", "running"))
    assert [p for p, _ in judged(frame, within, metadata="md")] == [True, False, False]
    equals = c.Metadata(key="status", equals="ready")
    assert judged(frame, equals, metadata="md") == [
        (True, ""),
        (False, "metadata key 'status' != 'ready'"),
        (False, "metadata key 'status' not present"),
    ]
    either = c.Or(c.Metadata(key="status", equals="missing"), c.Metadata(key="status", equals="also_missing"))
    assert [p for p, _ in judged(frame, either, metadata="md")] == [False, False, False]
    assert judged(frame, c.Metadata(), metadata="md")[0] == (False, "metadata key missing")


def test_metadata_compares_by_type(spark):
    frame = rows(spark, ({"k": "69"},), ({"k": '"69"'},), ({"k": "true"},), ({"k": "69.0"},), ({"k": "null"},), schema="md map<string,string>")

    def passes(**options):
        return [p for p, _ in judged(frame, c.Metadata(key="k", typed=True, **options), metadata="md")]

    assert passes(equals=69) == [True, False, False, True, False]
    assert passes(equals="69") == [False, True, False, False, False]
    assert passes(equals=True) == [False, False, True, False, False]
    assert passes() == [True, True, True, True, False]
    assert passes(within=(True, "69")) == [False, True, True, False, False]


def test_not_names_the_child(spark):
    got = judged(rows(spark, (1,), schema="x int"), c.Not(condition=c.AlwaysTrue(message="fine")))
    assert got == [(False, "NOT condition failed: child fine")]


def test_composite_reports_first_failure(spark):
    frame = rows(spark, (5, {"a": "1"}), schema="n int, md map<string,string>")
    first, second = c.Metadata(key="b"), c.MaxAttempts(max_attempts=1)
    got = judged(frame, c.And(c.AlwaysTrue(), first, second), attempts="n", metadata="md")
    assert got == [(False, "metadata key 'b' not present")]
    assert judged(frame, c.And()) == [(True, "")]
    assert judged(frame, c.Or()) == [(False, "all child conditions failed")]


def test_flags_of_children_do_not_latch(spark):
    big = c.Custom(kind="Flag", persistent_pass=True)
    c.register_condition("Flag", lambda _, scope: (F.col("flag"), F.lit("")))
    frame = rows(spark, (True,), (False,), schema="flag boolean")
    assert [p for p, _ in judged(frame, c.And(big))] == [True, False]
    assert [p for p, _ in judged(frame, big)] == [True, True]


def latched(sequence, keep_pass, keep_fail):
    state, out = None, []
    for raw in sequence:
        if state is None and (raw and keep_pass or not raw and keep_fail):
            state = raw
        out.append(raw if state is None else state)
    return out


@pytest.mark.parametrize("keep_pass,keep_fail", list(itertools.product([True, False], repeat=2)))
def test_latch_for_all_short_sequences(spark, keep_pass, keep_fail):
    sequences = [s for n in range(1, 7) for s in itertools.product([True, False], repeat=n)]
    data = [(i, k, raw) for i, s in enumerate(sequences) for k, raw in enumerate(s)]
    frame = spark.createDataFrame(data, "job int, k int, raw boolean")
    rule = c.AlwaysTrue(persistent_pass=keep_pass, persistent_fail=keep_fail)
    done = c.apply_latches(frame, {"out": ("raw", rule)}, ["job"], ["k"]).orderBy("job", "k").collect()
    got = {}
    for r in done:
        got.setdefault(r.job, []).append(r.out)
    assert got == {i: latched(s, keep_pass, keep_fail) for i, s in enumerate(sequences)}


def test_rows_without_a_key_are_kept(spark):
    frame = spark.createDataFrame([(None, 0, False), (None, 1, True), (None, 2, False), ("a", 0, False)], "job string, k int, raw boolean")
    done = c.apply_latches(frame, {"out": ("raw", c.AlwaysTrue(persistent_pass=True))}, ["job"], ["k"])
    assert sorted((r.job or "", r.k, r.out) for r in done.collect()) == [("", 0, False), ("", 1, True), ("", 2, True), ("a", 0, False)]


def test_latched_fail_of_a_spent_timeout(spark):
    frame = rows(spark, (1,), (1,), schema="x int")
    assert [p for p, _ in judged(frame, c.Timeout(timeout_seconds=0, persistent_fail=True))] == [False, False]


@pytest.fixture(scope="module")
def files(spark):
    paths = ["/r/a.done", "/r/b.done", "/r/b.txt", "/s/a.done", "/s/step_10.pt", "/s/step_1.pt", "/s/x/step_1.pt"]
    text = {"/r/a.done": "row-42", "/r/b.done": "no match here"}
    return spark.createDataFrame([(p, text.get(p, "")) for p in paths], "path string, content string")


def test_markers(spark, files):
    frame = rows(spark, ("r", "a"), ("s", "a"), ("s", "1"), ("t", "a"), schema="dir string, n string")
    names = {"dir": F.col("dir"), "n": F.col("n")}

    def passes(condition):
        return [p for p, _ in judged(frame, condition, markers=files, variables=names)]

    assert passes(c.FileExists(path="/{dir}/{n}.done")) == [True, True, False, False]
    assert passes(c.GlobExists(pattern="/{dir}/*.done", min_matches=2)) == [True, False, False, False]
    assert passes(c.GlobExists(pattern="/{dir}/*.done", min_matches=0)) == [True] * 4
    assert passes(c.GlobExists(pattern="/{dir}/step_{n}*.pt", min_matches=2)) == [False, False, True, False]
    assert passes(c.GlobExists(pattern="/{dir}/step_{n}?.p[a-t]")) == [False, False, True, False]
    assert passes(c.GlobExists(pattern="/{dir}/*_{n}.*")) == [False, False, True, False]
    assert passes(c.GlobExists(pattern="/{dir}/*[{n}].done")) == [True, True, False, False]
    assert passes(c.GlobExists(pattern="/{dir}/[!{n}]*")) == [True, True, True, False]
    assert passes(c.FileContent(path="/{dir}/{n}.done", pattern=r"row-\d+", mode="regex")) == [True, False, False, False]
    assert passes(c.FileContent(path="/{dir}/b.done", pattern="match")) == [True, True, False, False][:1] + [False] * 3
    both = c.And(c.FileExists(path="/{dir}/{n}.done"), c.Not(condition=c.FileExists(path="/{dir}/b.txt")))
    assert passes(both) == [False, True, False, False]


def at(seconds):
    return EPOCH + datetime.timedelta(seconds=seconds)


def test_markers_come_and_go(spark):
    versions = spark.createDataFrame(
        [
            ("/r/a.done", "step=1", at(2), None),
            ("/r/b.done", "x", at(4), True),
            ("/r/a.done", "step=2", at(5), True),
            ("/r/a.done", None, at(7), False),
            ("/s/a.done", "x", at(0), True),
        ],
        "path string, content string, ts timestamp_ntz, present boolean",
    )
    frame = rows(spark, *[("r", "a")] * 9, schema="dir string, n string")
    names = {"dir": F.col("dir"), "n": F.col("n")}

    def passes(condition):
        got = judged(frame, condition, markers=versions, variables=names, markers_at="ts")
        return "".join("x" if p else "." for p, _ in got)

    assert passes(c.FileExists(path="/{dir}/a.done")) == "..xxxxx.."
    assert passes(c.FileContent(path="/{dir}/a.done", pattern="=2")) == ".....xx.."
    assert passes(c.GlobExists(pattern="/{dir}/*.done", min_matches=2)) == "....xxx.."
    assert passes(c.GlobExists(pattern="/{dir}/{n}*", min_matches=1)) == "..xxxxx.."
    assert passes(c.GlobExists(pattern="/{dir}/*", min_matches=0)) == "x" * 9
    assert passes(c.FileExists(path="/{dir}/a.done", persistent_pass=True)) == "..xxxxxxx"


def test_marker_messages(spark, files):
    frame = rows(spark, ("q",), schema="dir string")
    names = {"dir": F.col("dir")}
    got = judged(frame, c.FileExists(path="/{dir}/x"), markers=files, variables=names)
    assert got == [(False, "file /q/x missing")]
    got = judged(frame, c.FileContent(path="/r/a.done", pattern="zzz"), markers=files, variables=names)
    assert got == [(False, "file /r/a.done content match failed")]


def test_many_waiters_on_one_marker_stay_as_many(spark, files):
    frame = spark.range(500).select(F.col("id").cast("int"), F.lit(EPOCH).cast("timestamp_ntz").alias("ts"))
    twice = files.unionAll(files)
    got = judged(frame, c.FileExists(path="/r/a.done"), markers=twice)
    assert got == [(True, "")] * 500


def test_markers_from_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "ready.txt").write_text("step=1")
    (tmp_path / "sub" / "x.done").write_bytes(b"\xff ok")
    got = {r.path: r.content for r in read_markers(spark, str(tmp_path)).collect()}
    assert got[str(tmp_path / "ready.txt")] == "step=1"
    assert got[str(tmp_path / "sub" / "x.done")].endswith(" ok")


def test_odd_globs_are_plain_characters(spark):
    files = spark.createDataFrame([("/r/a[b",), ("/r/x]y",), ("/r/[]",), ("/r/a.b+c",), ("/r/k^",)], "path string")
    globs = ("a[b", "[", "*[*", "[!]", "[]]*", "*.b+?", "*[^]", "?]?", "*", "[a-", "aXb")
    frame = rows(spark, *[(g,) for g in globs], schema="g string")
    got = judged(frame, c.GlobExists(pattern="/r/{g}"), markers=files, variables={"g": F.col("g")})
    import fnmatch

    names = [p.path[3:] for p in files.collect()]
    want = [any(fnmatch.fnmatchcase(name, g) for name in names) for g in globs]
    assert [p for p, _ in got] == want and want.count(True) > 5
