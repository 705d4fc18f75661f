"""Patterns and scalar expressions on small cases."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import regex, render

# Pairs of a pattern and texts on which both dialects must agree.
DIALECT = [
    (r"row-(\d+)", ["row-7 read, row-318 fine\nrow-0", "row-", "row-٣"]),
    (r"(?P<word_1>\w+)-(?P=word_1)", ["ab-ab é-é x-y", ""]),
    (r"^x*", ["", "\n", "x\nxx\n", "a\r\nb"]),
    (r"$", ["", "a\n", "a\nb"]),
    (r".+$", ["a\rb\nc", "a b"]),
    (r"a{2,}|b{,2}c|d{e|}", ["aaa bbc d{e }", "bbbc"]),
    (r"[[a&&b]+", ["[[a&b", "ab"]),
    (r"[]x]+", ["]]x", ""]),
    (r"\bfoo\b", ["foo bar éfoo foo_ foo", ""]),
    (r"(?i)É+", ["éÉé e", ""]),
    (r"a\Z", ["a\na", "a\n"]),
    (r"[^\W\d_]+", ["abc123é_z", ""]),
    (r"x\v\x41\101", ["x\x0bAA", "x"]),
    (r"(a|b)?c", ["ac c bc", ""]),
]


@pytest.mark.parametrize("pattern,texts", DIALECT)
def test_both_dialects_find_the_same(spark, pattern, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = frame.select("i", F.regexp_extract_all("t", F.lit(regex.to_jvm(pattern)), F.lit(0)).alias("m"))
    got = {r.i: r.m for r in found.collect()}
    want = {i: [m.group(0) for m in re.finditer(pattern, t, re.MULTILINE)] for i, t in enumerate(texts)}
    assert got == want


def test_patterns_without_counterpart_are_refused():
    for pattern in (r"(a)?(?(1)b|c)", r"(?x)a b"):
        with pytest.raises(regex.UnsupportedPattern):
            regex.to_jvm(pattern)


def test_groups_are_resolved_on_the_driver():
    assert regex.group_number(r"(?P<kind>a)(b)", "kind") == 1
    assert regex.group_number(r"(a)(b)", 2) == 2
    assert regex.group_number(r"(a)", 9) is None
    assert regex.group_number(r"(a)", "none") is None
    assert regex.optional_groups(r"(a)|(b)(c)?") == {1, 2, 3}
    assert regex.optional_groups(r"((a)?b)+") == {2}


@pytest.mark.parametrize(
    "pattern,literal",
    [
        (r'token = "([0-9a-f]+)"', 'token = "'),
        (r"Released (under) the [A-Z]+", "Released under the "),
        (r"(abc)?def", "def"),
        (r"abcd|x", None),
        (r"(?i)abcd", None),
        (r"a\.b", "a.b"),
        (r"abc+d", "ab"),
    ],
)
def test_required_literal(pattern, literal):
    assert regex.required_literal(pattern, 2) == literal


def test_quote(spark):
    odd = r"a\Eb.*\Qc$"
    row = spark.createDataFrame([(f"x{odd}y",)], "t string")
    assert row.select(F.regexp_extract("t", regex.quote(odd), 0)).first()[0] == odd


@pytest.mark.parametrize(
    "glob,yes,no",
    [
        ("step_*.pt", ["step_1.pt", "step_.pt"], ["step_1.ptx", "xstep_1.pt"]),
        ("a?c[0-9]", ["abc1"], ["ac1", "abcx"]),
        ("[!x]*", ["y", "abc"], ["x1"]),
        ("a[b", ["a[b"], ["ab"]),
    ],
)
def test_glob(spark, glob, yes, no):
    frame = spark.createDataFrame([(n,) for n in yes + no], "n string")
    fits = frame.filter(F.regexp_like("n", F.lit(regex.glob_to_jvm(glob)))).collect()
    assert {r.n for r in fits} == set(yes)


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


def test_templates(spark):
    scope = {"job_id": F.lit(1), "none": F.lit(None).cast("string")}
    assert one(spark, render.render("{job_id}/{absent}/${job_id}/{none}/{x:y}", scope)) == "1/{absent}/${job_id}/None/{x:y}"
    variables = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("wrong"), F.lit("n"), F.lit(None).cast("string"))
    text = "{a}-{b}{c}${a}{n}"
    want = "{b}-wrong{c}${a}None"
    assert one(spark, render.render_from_map(text, variables)) == want
    assert one(spark, render.render_column(F.lit(text), variables)) == want
    assert one(spark, render.render_column(F.lit("no keys"), variables)) == "no keys"
    assert one(spark, render.render_column(F.lit("{a}"), variables)) == "{b}"


@pytest.mark.parametrize(
    "path,job,ts,want",
    [
        ("out/%A/part-%a.txt", "8071_12", None, "out/8071/part-12.txt"),
        ("%j.%A.%a", "640", None, "640.640.0"),
        ("t%t-%j", "run-2", 31, "t31-run-2"),
        ("%A|%a", "1_2_3", None, "1|2_3"),
    ],
)
def test_log_paths(spark, path, job, ts, want):
    stamp = None if ts is None else F.lit(ts)
    assert one(spark, render.expand_log_path(F.lit(path), F.lit(job), stamp)) == want


def test_current_log_path(spark):
    def path(current, runtime):
        none = F.lit(None).cast("string")
        return one(
            spark,
            render.effective_log_path(
                F.lit("l/%j_%t"), none if current is None else F.lit(current), F.lit("job"), none if runtime is None else F.lit(runtime), F.lit(7)
            ),
        )

    assert path("cur_%a.log", "9_3") == "cur_3.log"
    assert path("cur_%a.log", None) == "cur_0.log"
    assert path(None, "9_3") == "l/9_3_7"
    assert path("", None) == "l/job_7"
    assert path(None, "9_x") is None


def test_identifiers(spark):
    at = F.lit(datetime.datetime(1970, 1, 1, 0, 0, 0, 123999)).cast("timestamp_ntz")
    assert one(spark, render.event_id(F.lit("n17"), F.lit("saved"), at, F.lit(8))) == "n17:saved:8:123"
    assert one(spark, render.event_id(F.lit("job1"), F.lit("e"), at)) == "job1:e:123"
    assert one(spark, render.action_id(F.lit("log"), F.lit("e"), F.lit(0))) == "log:e:0"
    assert one(spark, render.event_key(F.lit('{"k":1}'))) == one(spark, render.event_key(F.lit('{"k":1}')))


def test_status_from_return_code(spark):
    frame = spark.createDataFrame([(True, 1, "x"), (True, 0, "x"), (True, None, "x"), (False, None, "PENDING")], "p boolean, c int, s string")
    got = frame.select(render.status_from_return_code(F.col("p"), F.col("c"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["FAILED", "COMPLETED", "RUNNING", "PENDING"]
