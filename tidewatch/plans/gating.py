"""Queries on conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import conditions as c
from tidewatch.operators.actions import Action, action_results, register_action
from tidewatch.operators.cooldown import cooldown_firings
from tidewatch.operators.lifecycle import action_state, attempt_numbers, decide
from tidewatch.operators.rules import LogRule
from tidewatch.plans.tables import JOBS_SQL, jobs, markers, query, table
from tidewatch.session import scratch_path
from tidewatch.sources.markers import read_markers

ORDER = ["ts", "event_id"]
DAY = 86400.0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their number as attempts, and JSON-typed metadata."""
    value = F.get_json_object("props", "$.k")
    typed = F.create_map(F.lit("k"), value, F.lit("kind"), F.concat(F.lit('"'), "event_type", F.lit('"')))
    some = F.when(F.col("value") > 50, typed).otherwise(F.create_map(F.lit("kind"), F.lit("null")))
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", some.alias("md"), value.cast("int").alias("attempts")
    )


def _judge(rows: DataFrame, condition: c.Condition, **options) -> DataFrame:
    return c.evaluate(rows, condition, ["user_id", "event_type"], ORDER, **options)


@query("cond_always", "SELECT event_id, true AS passed, 'go' AS message FROM events")
def cond_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judge(_events(spark, sf_dir), c.AlwaysTrue(message="go")).select("event_id", "passed", "message")


ATTEMPTS = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query(
    "cond_max_attempts",
    f"""SELECT event_id, {ATTEMPTS} < 40 AS passed,
      CASE WHEN {ATTEMPTS} < 40 THEN '' ELSE 'attempts ' || {ATTEMPTS} || ' >= limit 40' END AS message FROM events""",
)
def cond_max_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _judge(_events(spark, sf_dir), c.MaxAttempts(max_attempts=40), attempts="attempts")
    return done.select("event_id", "passed", "message")


@query(
    "cond_metadata",
    f"""SELECT event_id, coalesce(value > 50, false) AS k_there, coalesce(value > 50 AND {ATTEMPTS} = 69, false) AS k_number,
      false AS k_text, coalesce(value > 50 AND event_type IN ('view', 'click'), false) AS kind_within,
      CASE WHEN value > 50 THEN CASE WHEN {ATTEMPTS} = 69 THEN '' ELSE 'metadata key ''k'' != 69' END
        ELSE 'metadata key ''k'' not present' END AS message FROM events""",
)
def cond_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number 69 equals k; the text "69" does not."""
    scope = c.Scope(metadata=F.col("md"))
    number = c.Metadata(key="k", equals=69, typed=True).compile(scope)
    tests = {
        "k_there": c.Metadata(key="k", typed=True).compile(scope)[0],
        "k_number": number[0],
        "k_text": c.Metadata(key="k", equals="69", typed=True).compile(scope)[0],
        "kind_within": c.Metadata(key="kind", within=("view", "click"), typed=True).compile(scope)[0],
        "message": number[1],
    }
    return _events(spark, sf_dir).select("event_id", *[test.alias(name) for name, test in tests.items()])


BIG = c.Metadata(key="k", typed=True)
VIEW = c.Metadata(key="kind", equals="view", typed=True)
FEW = c.MaxAttempts(max_attempts=40)
PARTS_SQL = f"""parts AS (SELECT event_id, value > 50 AS big, value > 50 AND event_type = 'view' AS vw,
  {ATTEMPTS} < 40 AS few, 'attempts ' || {ATTEMPTS} || ' >= limit 40' AS few_text FROM events)"""


@query(
    "cond_composite",
    f"""WITH {PARTS_SQL} SELECT event_id, big AND vw AND few AS all_pass, big OR vw OR few AS any_pass,
      big AND (vw OR few) AS nested_pass, true AS empty_all, false AS empty_any,
      CASE WHEN big AND vw AND few THEN '' WHEN NOT big THEN 'metadata key ''k'' not present'
        WHEN NOT vw THEN 'metadata key ''kind'' != ''view''' ELSE few_text END AS all_message FROM parts""",
)
def cond_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = c.Scope(metadata=F.col("md"), attempts=F.col("attempts"))
    every = c.And(BIG, VIEW, FEW).compile(scope)
    return _events(spark, sf_dir).select(
        "event_id",
        every[0].alias("all_pass"),
        every[1].alias("all_message"),
        c.Or(BIG, VIEW, FEW).compile(scope)[0].alias("any_pass"),
        c.And(BIG, c.Or(VIEW, FEW)).compile(scope)[0].alias("nested_pass"),
        c.And().compile(scope)[0].alias("empty_all"),
        c.Or().compile(scope)[0].alias("empty_any"),
    )


@query(
    "cond_not",
    f"""WITH {PARTS_SQL} SELECT event_id, NOT few AS passed,
      CASE WHEN few THEN 'NOT condition failed: child ' ELSE '' END AS message FROM parts""",
)
def cond_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _judge(_events(spark, sf_dir), c.Not(condition=FEW), attempts="attempts")
    return done.select("event_id", "passed", "message")


def _value_over(condition: c.Custom, scope: c.Scope) -> tuple[Column, Column]:
    passed = F.col("value") > condition.options["limit"]
    return passed, F.when(passed, "").otherwise("value too small")


c.register_condition("ValueOver", _value_over)
HIGH = c.Custom(kind="ValueOver", options={"limit": 50})


@query(
    "custom_condition",
    """SELECT event_id, value > 50 AS passed, CASE WHEN value > 50 THEN '' ELSE 'value too small' END AS message
    FROM events""",
)
def custom_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judge(_events(spark, sf_dir), HIGH).select("event_id", "passed", "message")


register_action("PageOwner", lambda action, variables: ("finish", F.concat(F.lit("page "), F.element_at(variables, "owner"))))


@query(
    "custom_action",
    """SELECT event_id, 'finish' AS effect, 'finished' AS outcome, 'page ' || user_id AS message
    FROM events WHERE event_type = 'error'""",
)
def custom_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = LogRule("paging", "error", action=Action("PageOwner"))
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == "error").withColumn("rule_idx", F.lit(0))
    owner = F.create_map(F.lit("owner"), F.col("user_id").cast("string"))
    return action_results(rows, [(0, rule)], owner).select("event_id", "effect", "outcome", "message")


@query(
    "cond_timeout",
    """SELECT event_id, ts - min(ts) OVER (PARTITION BY user_id, event_type) < INTERVAL 10 DAY AS passed FROM events""",
)
def cond_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judge(_events(spark, sf_dir), c.Timeout(timeout_seconds=10 * DAY)).select("event_id", "passed")


@query(
    "cond_latch",
    """SELECT event_id, value > 50 AS plain, max(value > 50) OVER w AS sticks_true, min(value > 50) OVER w AS sticks_false,
      first(value > 50) OVER w AS sticks_both FROM events WINDOW w AS (PARTITION BY user_id, event_type
      ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def cond_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", (F.col("value") > 50).alias("plain"))
    latches = {
        "sticks_true": ("plain", c.AlwaysTrue(persistent_pass=True)),
        "sticks_false": ("plain", c.AlwaysTrue(persistent_fail=True)),
        "sticks_both": ("plain", c.AlwaysTrue(persistent_pass=True, persistent_fail=True)),
    }
    rows = c.apply_latches(rows, latches, ["user_id", "event_type"], ORDER)
    return rows.select("event_id", "plain", "sticks_true", "sticks_false", "sticks_both")


@query(
    "gated_triggers",
    """WITH judged AS (SELECT *, value > 50 AND ts - min(ts) OVER (PARTITION BY user_id, event_type) < INTERVAL 20 DAY AS raw
      FROM events), latched AS (SELECT *, max(raw) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS passed FROM judged)
    SELECT event_id, user_id, event_type, ts FROM latched WHERE passed""",
)
def gated_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = c.And(HIGH, c.Timeout(timeout_seconds=20 * DAY), persistent_pass=True)
    return _judge(_events(spark, sf_dir), gate).filter("passed").select("event_id", "user_id", "event_type", "ts")


def _waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as jobs that wait for the address without its query and fragment."""
    base = F.regexp_extract("url", r"^([^?#]*)", 1)
    folder = F.regexp_extract("url", r"^(.*)/", 1)
    word = F.regexp_extract("url", r"(?:page|utm_source)=([a-z0-9]+)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", base.alias("base"), folder.alias("folder"), word.alias("word"), "url"
    )


def _check(spark: SparkSession, sf_dir: str, condition: c.Condition) -> DataFrame:
    names = {"base": F.col("base"), "folder": F.col("folder"), "word": F.col("word"), "url": F.col("url")}
    done = c.evaluate(_waiting(spark, sf_dir), condition, ["page_id"], ["page_id"], markers(spark, sf_dir), names)
    return done.select("page_id", "passed", "message")


BASE_SQL = r"regexp_extract(url, '^([^?#]*)', 1)"
FOLDER_SQL = "regexp_extract(url, '^(.*)/', 1)"


@query(
    "cond_marker_exists",
    f"""SELECT page_id, b IN (SELECT url FROM pages) AS passed,
      CASE WHEN b IN (SELECT url FROM pages) THEN '' ELSE 'file ' || b || ' missing' END AS message
    FROM (SELECT page_id, {BASE_SQL} AS b FROM pages)""",
)
def cond_marker_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, c.FileExists(path="{base}"))


@query(
    "cond_marker_count",
    f"""WITH files AS (SELECT DISTINCT url, {FOLDER_SQL} AS dir, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages),
    waits AS (SELECT page_id, {FOLDER_SQL} AS dir, url, regexp_extract(url, '(page|utm_source)=([a-z0-9]+)', 2) AS word
      FROM pages),
    n AS (SELECT page_id, dir, word, (SELECT count(*) FROM files f WHERE f.dir = w.dir AND regexp_matches(f.base, '^[0-9].*[=].*$'))
      AS fixed, (SELECT count(*) FROM files f WHERE f.dir = w.dir AND contains(f.base, '=' || w.word)) AS varied FROM waits w)
    SELECT page_id, fixed >= 1 AND varied >= 1 AS passed, CASE WHEN fixed < 1 THEN 'glob ' || dir || '/[0-9]*=* missing'
      WHEN varied < 1 THEN 'glob ' || dir || '/*=' || word || '* missing' ELSE '' END AS message FROM n""",
)
def cond_marker_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One glob with a fixed last segment, one whose last segment differs by job."""
    fixed = c.GlobExists(pattern="{folder}/[0-9]*=*", min_matches=1)
    varied = c.GlobExists(pattern="{folder}/*={word}*", min_matches=1)
    return _check(spark, sf_dir, c.And(fixed, varied))


@query(
    "cond_marker_content",
    f"""WITH files AS (SELECT url, contains(html, '<script') AS s, regexp_matches(html, '<h[12]>[A-Z]') AS r FROM pages),
    waits AS (SELECT page_id, url, {BASE_SQL} AS b FROM pages)
    SELECT page_id, coalesce(f.s, false) OR g.r AS passed, CASE WHEN coalesce(f.s, false) OR g.r THEN ''
      WHEN f.url IS NULL THEN 'file ' || b || ' missing' ELSE 'file ' || b || ' content match failed' END AS message
    FROM waits w LEFT JOIN files f ON w.b = f.url JOIN files g ON w.url = g.url""",
)
def cond_marker_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = c.FileContent(path="{base}", pattern="<script")
    regex = c.FileContent(path="{url}", pattern="<h[12]>[A-Z]", mode="regex")
    return _check(spark, sf_dir, c.Or(literal, regex))


@query(
    "cond_marker_asof",
    """WITH versions AS (SELECT user_id, ts, value <= 50 AS here FROM events WHERE event_type = 'signup'),
    folder AS (SELECT user_id, event_type, ts, value <= 50 AS here,
      lag(value <= 50, 1, false) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was FROM events),
    rows AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
    one AS (SELECT event_id, coalesce(here, false) AS file_there FROM rows ASOF LEFT JOIN versions v
      ON rows.user_id = v.user_id AND rows.ts >= v.ts),
    turns AS (SELECT user_id, ts, sum(CAST(here AS INTEGER) - CAST(was AS INTEGER)) OVER (PARTITION BY user_id
      ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS files FROM folder),
    many AS (SELECT event_id, coalesce(files, 0) >= 4 AS four_there FROM rows ASOF LEFT JOIN turns t
      ON rows.user_id = t.user_id AND rows.ts >= t.ts)
    SELECT * FROM one JOIN many USING (event_id)""",
)
def cond_marker_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user has a folder of files named by event type; small values write the file, large ones remove it."""
    events = table(spark, sf_dir, "events")
    versions = events.select(
        F.concat_ws("/", F.lit("/users"), F.col("user_id").cast("string"), "event_type").alias("path"),
        F.lit("").alias("content"),
        "ts",
        (F.col("value") <= 50).alias("present"),
    )
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    user = {"user": F.col("user_id")}
    exists = c.FileExists(path="/users/{user}/signup")
    four = c.GlobExists(pattern="/users/{user}/*", min_matches=4)
    options = {"markers": versions, "variables": user, "markers_at": "ts"}
    first = c.evaluate(views, exists, ["user_id"], ORDER, **options)
    second = c.evaluate(
        first.select("event_id", "user_id", "ts", F.col("passed").alias("file_there")), four, ["user_id"], ORDER, **options
    )
    return second.select("event_id", "file_there", F.col("passed").alias("four_there"))


@query(
    "cooldown_greedy",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
      FROM events WHERE event_type = 'error'),
    f AS (SELECT user_id, event_id, n, true AS fired, ts AS last FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.event_id, e.n, e.ts - f.last >= INTERVAL 24 HOUR,
        CASE WHEN e.ts - f.last >= INTERVAL 24 HOUR THEN e.ts ELSE f.last END
      FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, event_id, fired FROM f""",
)
def cooldown_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "event_id", "ts")
    return cooldown_firings(errors, "user_id", ORDER, DAY).select("user_id", "event_id", "fired")


@query(
    "attempt_segments",
    """SELECT user_id, event_id, 1 + coalesce(CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER
      (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS attempt
    FROM events""",
)
def attempt_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    numbered = attempt_numbers(rows, "user_id", ORDER, F.col("event_type") == "error")
    return numbered.select("user_id", "event_id", "attempt")


@query(
    "action_state_table",
    """SELECT user_id AS job_id, 'log:' || event_type || ':0' AS action_id, max(ts) AS last_action_ts,
      'success' AS last_status FROM events WHERE value > 50 GROUP BY user_id, event_type""",
)
def action_state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("user_id", "job_id")
    fired = c.evaluate(rows, HIGH, ["job_id"], ORDER).filter("passed")
    return action_state(fired, F.concat_ws(":", F.lit("log"), "event_type", F.lit("0")))


@query(
    "lifecycle_decision",
    f"""WITH {JOBS_SQL}, items AS (SELECT l_orderkey AS job_id, max(l_quantity) AS q, bool_or(l_returnflag = 'R') AS r
      FROM lineitem GROUP BY 1)
    SELECT job_id, CASE WHEN q > 49 THEN 'cancelled' WHEN attempts = 5 AND r THEN 'finished'
      WHEN NOT submitted AND coalesce(r, true) THEN 'start' WHEN NOT submitted THEN 'wait'
      WHEN q < 10 THEN 'restart' WHEN last_status = 'COMPLETED' THEN 'finished' ELSE 'continue' END AS decision
    FROM jobs LEFT JOIN items USING (job_id)""",
)
def lifecycle_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.max("l_quantity").alias("q"), F.bool_or(F.col("l_returnflag") == "R").alias("r")
    )
    decision = decide(
        submitted=F.col("submitted"),
        cancel=F.col("q") > 49,
        finish=F.when(F.col("attempts") == 5, F.col("r")),
        start=F.col("r"),
        log_outcome=F.when(F.col("q") < 10, "restart").otherwise("continue"),
        status=F.col("last_status"),
    )
    return jobs(spark, sf_dir).join(items, "job_id", "left").select("job_id", decision.alias("decision"))


@query(
    "marker_source",
    """SELECT CAST(page_id % 40 AS VARCHAR) AS marker, md5(string_agg(html || chr(10), '' ORDER BY page_id)) AS content_md5,
      CAST(sum(strlen(html) + 1) AS BIGINT) AS n_bytes FROM pages GROUP BY 1""",
)
def marker_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as forty marker files, found below a folder and read with their content."""
    folder = scratch_path(spark, "markers")
    pages = table(spark, sf_dir, "pages").withColumn("marker", F.col("page_id") % 40)
    pages.repartition("marker").sortWithinPartitions("marker", "page_id").select("marker", "html").write.partitionBy("marker").text(folder)
    found = read_markers(spark, folder)
    return found.select(
        F.regexp_extract("path", "marker=([0-9]+)/", 1).alias("marker"), F.md5("content").alias("content_md5"), F.octet_length("content").cast("bigint").alias("n_bytes")
    )
