"""Queries on the job registry, identifiers, paths and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import render
from tidewatch.operators import reports
from tidewatch.operators.lifecycle import start_results
from tidewatch.plans.tables import JOBS_SQL, jobs, query, table
from tidewatch.session import scratch_path
from tidewatch.sources import registry

SCAN = ("job_id", "name", "last_status", "submitted", "attempts", "runtime_job_id")
SCAN_SQL = ", ".join(SCAN)


@query(
    "registry_scan",
    f"""WITH {JOBS_SQL} SELECT CAST(job_id AS VARCHAR) AS job_id, name, last_status, submitted, attempts, runtime_job_id
    FROM jobs WHERE final_state IS NULL AND attempts <> 4""",
)
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as written records, those of priority 4 cut off while written; older records use the older key."""
    path = scratch_path(spark, "records")
    definition = F.struct("name", "log_path", "array_len")
    runtime = F.struct("submitted", "attempts", "runtime_job_id", "last_status", "final_state")
    record = {"job_id": F.col("job_id").cast("string"), "runtime": runtime}
    now = F.to_json(F.struct(*[v.alias(k) for k, v in record.items()], definition.alias("definition")))
    old = F.to_json(F.struct(*[v.alias(k) for k, v in record.items()], definition.alias("registration")))
    line = F.when(F.col("attempts") == 5, old).otherwise(now)
    line = F.when(F.col("attempts") == 4, F.substring(line, 1, 40)).otherwise(line)
    jobs(spark, sf_dir).select(line.alias("value")).write.text(path)
    records = registry.read_records(spark, path, files="*.txt", lines=True)
    return registry.flatten(registry.scan(records)).select(*SCAN)


@query(
    "registry_valid_json",
    """SELECT event_id, json_valid(CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1)
      ELSE props END) AS valid FROM events""",
)
def registry_valid_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events stand for records that were cut off while written."""
    cut = F.expr("CASE WHEN event_type = 'error' THEN substring(props, 1, length(props) - 1) ELSE props END")
    return table(spark, sf_dir, "events").select("event_id", registry.valid_json(cut).alias("valid"))


@query(
    "registry_lookup",
    f"""WITH {JOBS_SQL}, last AS (SELECT max(job_id) FILTER (final_state IS NULL) AS open, max(job_id) FILTER
      (final_state IS NOT NULL) AS finished, max(job_id) + 1 AS nobody FROM jobs),
    asked AS (SELECT open AS wanted, false AS every FROM last UNION ALL SELECT finished, false FROM last
      UNION ALL SELECT finished, true FROM last UNION ALL SELECT nobody, true FROM last)
    SELECT wanted, every, {SCAN_SQL} FROM asked LEFT JOIN jobs ON job_id = wanted AND (every OR final_state IS NULL)""",
)
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest open job, the newest finished one without and with finished jobs, and one that does not exist."""
    known, is_open = jobs(spark, sf_dir), F.col("final_state").isNull()
    keys = known.agg(
        F.max(F.when(is_open, F.col("job_id"))).alias("open"),
        F.max(F.when(~is_open, F.col("job_id"))).alias("finished"),
        (F.max("job_id") + 1).alias("nobody"),
    ).first()
    parts = []
    for wanted, every in ((keys.open, False), (keys.finished, False), (keys.finished, True), (keys.nobody, True)):
        found = registry.lookup(known, wanted, every).select(*SCAN)
        asked = spark.range(1).select(F.lit(wanted).cast("bigint").alias("wanted"), F.lit(every).alias("every"))
        parts.append(asked.join(found, F.col("job_id") == F.col("wanted"), "left"))
    return reduce(DataFrame.unionByName, parts)


@query(
    "registry_submit",
    f"""WITH {JOBS_SQL}, sent AS (SELECT c_custkey AS job_id, c_name AS name, c_nationkey AS attempts FROM customer)
    SELECT job_id, coalesce(sent.name, jobs.name) AS name, coalesce(sent.attempts, jobs.attempts) AS attempts,
      CASE WHEN sent.job_id IS NULL THEN jobs.last_status END AS last_status
    FROM jobs FULL JOIN sent USING (job_id)""",
)
def registry_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for payloads: those with the id of a job replace it, the others are new jobs."""
    known = jobs(spark, sf_dir).select("job_id", "name", "attempts", "last_status", F.lit(0).alias("ts"), F.lit(0).alias("seq"))
    sent = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("job_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("int").alias("attempts"),
        F.lit(1).alias("ts"),
        F.lit(0).alias("seq"),
    )
    return registry.submit(known, sent).select("job_id", "name", "attempts", "last_status")


@query(
    "registry_upsert",
    """SELECT user_id AS job_id, arg_max(event_id, (ts, event_id)) AS seq, max(ts) AS ts,
      arg_max(event_type, (ts, event_id)) AS last_status, arg_max(value, (ts, event_id)) AS value
    FROM events GROUP BY user_id""",
)
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes of job records; the last of each user stays."""
    writes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.col("event_type").alias("last_status"),
        "value",
    )
    return registry.upsert(writes)


@query(
    "registry_remove",
    f"""WITH {JOBS_SQL} SELECT {SCAN_SQL} FROM jobs
      WHERE group_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def registry_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("group_id"))
    return registry.remove(jobs(spark, sf_dir), doomed, "group_id").select(*SCAN)


@query(
    "retention_done_only",
    f"""WITH {JOBS_SQL} SELECT job_id, 'active' AS scope FROM jobs
      WHERE last_status IN ('COMPLETED', 'FAILED', 'CANCELLED') AND final_state IS NULL
    UNION ALL SELECT job_id, 'all' FROM jobs
      WHERE last_status IN ('COMPLETED', 'FAILED', 'CANCELLED') OR final_state IS NOT NULL""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for scope in ("active", "all"):
        removed, _ = registry.cleanup(jobs(spark, sf_dir), done_only=True, scope=scope)
        parts.append(removed.select("job_id", F.lit(scope).alias("scope")))
    return parts[0].unionByName(parts[1])


@query(
    "registry_mark_finished",
    f"""WITH {JOBS_SQL}, done AS (SELECT l_orderkey AS job_id, min(l_shipdate) AS at,
      arg_min(l_returnflag, (l_shipdate, l_returnflag)) AS flag FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT jobs.job_id, coalesce(final_state, CASE WHEN done.job_id IS NOT NULL THEN 'cancelled' END) AS final_state,
      CASE WHEN final_state IS NULL THEN done.at ELSE end_ts END AS end_ts FROM jobs LEFT JOIN done USING (job_id)""",
)
def registry_mark_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = (
        table(spark, sf_dir, "lineitem")
        .filter("l_linestatus = 'F'")
        .select(F.col("l_orderkey").alias("job_id"), F.lit("cancelled").alias("state"), F.col("l_shipdate").alias("at"))
    )
    return registry.mark_finished(jobs(spark, sf_dir), done).select("job_id", "final_state", "end_ts")


@query(
    "start_results",
    f"""WITH {JOBS_SQL} SELECT job_id, attempts + 1 AS attempts, start_ts,
      CASE WHEN c_acctbal >= 0 THEN c_name || '-' || job_id END AS runtime_job_id,
      coalesce(c_acctbal >= 0, false) AS submitted, CASE WHEN c_acctbal >= 0 THEN 0 END AS log_cursor
    FROM jobs LEFT JOIN customer ON group_id = c_custkey WHERE NOT jobs.submitted""",
)
def start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting jobs are started; no id comes back for customers in debt."""
    waiting = jobs(spark, sf_dir).filter(~F.col("submitted"))
    owners = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    ids = waiting.join(owners, F.col("group_id") == F.col("c_custkey")).select(
        "job_id", F.concat_ws("-", "c_name", F.col("job_id").cast("string")).alias("runtime_job_id")
    )
    return start_results(waiting.withColumnRenamed("start_ts", "ts"), ids)


LOG_EVENTS = """array(
  named_struct('name', 'oom', 'pattern', 'OOM', 'action', 'RestartAction'),
  named_struct('name', name, 'pattern', concat('step ', group_id), 'action', if(submitted, 'LogAction', null)),
  named_struct('name', 'end', 'pattern', 'DONE', 'action', if(last_status = 'COMPLETED', 'FinishAction', null)))"""


@query(
    "rules_explode",
    f"""WITH {JOBS_SQL} SELECT job_id, 0 AS rule_idx, 'oom' AS name, 'OOM' AS pattern, 'RestartAction' AS action FROM jobs
    UNION ALL SELECT job_id, 1, name, 'step ' || group_id, 'LogAction' FROM jobs WHERE submitted
    UNION ALL SELECT job_id, 2, 'end', 'DONE', 'FinishAction' FROM jobs WHERE last_status = 'COMPLETED'""",
)
def rules_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.log_rules(jobs(spark, sf_dir).withColumn("log_events", F.expr(LOG_EVENTS)))


@query(
    "array_expand",
    f"""WITH {JOBS_SQL} SELECT CASE WHEN array_len > 1 THEN job_id || '_' || i ELSE CAST(job_id AS VARCHAR) END AS job_id,
      CASE WHEN array_len > 1 THEN i END AS array_idx, CASE WHEN array_len > 1 THEN attempts + 1 ELSE attempts END AS attempts,
      array_len > 1 OR submitted AS submitted, CASE WHEN array_len > 1 THEN group_id || '-' || i ELSE runtime_job_id END AS runtime_job_id,
      CASE WHEN array_len > 1 THEN 0 ELSE 7 END AS log_cursor,
      CASE WHEN array_len > 1 THEN CAST('2030-01-01' AS TIMESTAMP) ELSE start_ts END AS start_ts
    FROM jobs, range(array_len) t(i) WHERE array_len = 1 OR i < 3""",
)
def array_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ids come back at most."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat_ws("-", "group_id", i.cast("string")))
    waiting = jobs(spark, sf_dir).withColumn("log_cursor", F.lit(7))
    started = F.lit("2030-01-01").cast("timestamp_ntz")
    tasks = registry.expand_arrays(waiting, ids, started)
    return tasks.select("job_id", "array_idx", "attempts", "submitted", "runtime_job_id", "log_cursor", "start_ts")


@query(
    "job_metadata_defaults",
    f"""WITH {JOBS_SQL} SELECT job_id AS job, CASE WHEN submitted THEN 'own' ELSE CAST(job_id AS VARCHAR) END AS job_id,
      CASE WHEN attempts = 1 THEN 'urgent' ELSE name END AS job_name, 'LocalJob' AS job_class, CAST(group_id AS VARCHAR) AS owner
    FROM jobs""",
)
def job_metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("submitted"), F.create_map(F.lit("job_id"), F.lit("own"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    urgent = F.when(F.col("attempts") == 1, F.create_map(F.lit("job_name"), F.lit("urgent"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    given = F.map_concat(own, urgent, F.create_map(F.lit("owner"), F.col("group_id").cast("string")))
    full = render.with_job_defaults(given, F.col("job_id"), F.col("name"), F.lit("LocalJob"))
    keys = ("job_id", "job_name", "job_class", "owner")
    rows = jobs(spark, sf_dir).select(F.col("job_id").alias("job"), full.alias("m"))
    return rows.select("job", *[F.col("m")[k].alias(k) for k in keys])


@query(
    "resolve_log_path",
    f"""WITH {JOBS_SQL}, ids AS (SELECT *, CASE WHEN array_len > 3 THEN job_id || '_' || attempts || '_x'
      WHEN array_len > 1 THEN job_id || '_' || attempts ELSE CAST(job_id AS VARCHAR) END AS id FROM jobs),
    cut AS (SELECT *, CASE WHEN contains(id, '_') THEN substr(id, 1, strpos(id, '_') - 1) ELSE id END AS head,
      CASE WHEN contains(id, '_') THEN substr(id, strpos(id, '_') + 1) ELSE '0' END AS tail FROM ids)
    SELECT job_id, replace(replace(replace(replace(log_path, '%A', head), '%a', tail), '%j', id), '%t',
      CAST(epoch_us(start_ts) // 1000000 AS VARCHAR)) AS path FROM cut""",
)
def resolve_log_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    job_id, tries = F.col("job_id").cast("string"), F.col("attempts").cast("string")
    used = (
        F.when(F.col("array_len") > 3, F.concat_ws("_", job_id, tries, F.lit("x")))
        .when(F.col("array_len") > 1, F.concat_ws("_", job_id, tries))
        .otherwise(job_id)
    )
    seconds = F.unix_seconds(F.col("start_ts").cast("timestamp"))
    return jobs(spark, sf_dir).select("job_id", render.expand_log_path(F.col("log_path"), used, seconds).alias("path"))


@query(
    "effective_log_path",
    f"""WITH {JOBS_SQL}, ids AS (SELECT *, job_id || '_' || name || '_' || attempts AS tagged FROM jobs)
    SELECT job_id, CASE WHEN last_status = 'RUNNING' THEN 'cur_' || attempts || '.log'
      WHEN last_status = 'COMPLETED' THEN NULL
      ELSE 'logs/' || job_id || '/0_' || job_id || '_' || epoch_us(start_ts) // 1000000 || '.log' END AS path FROM ids""",
)
def effective_log_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs have a current log and array ids, completed ones an id without a number, others none."""
    job_id = F.col("job_id").cast("string")
    runtime = F.when(
        F.col("last_status") == "RUNNING", F.concat_ws("_", job_id, "name", F.col("attempts").cast("string"))
    ).when(F.col("last_status") == "COMPLETED", F.concat_ws("_", job_id, F.lit("x")))
    current = F.when(F.col("last_status") == "RUNNING", "cur_%a.log").otherwise("")
    seconds = F.unix_seconds(F.col("start_ts").cast("timestamp"))
    path = render.effective_log_path(F.col("log_path"), current, job_id, runtime, seconds)
    return jobs(spark, sf_dir).select("job_id", path.alias("path"))


@query(
    "render_message",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'user ' || user_id || ' got {0} in ${user_id} {missing}'
      WHEN event_type = 'view' THEN '{v}' || user_id || 'None' ELSE event_type || ': ' || value_text END AS message
    FROM (SELECT *, props AS value_text FROM events)""",
)
def render_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that differ by row; a value that looks like a placeholder is not expanded again."""
    template = (
        F.when(F.col("event_type") == "error", "user {user_id} got {0} in ${user_id} {missing}")
        .when(F.col("event_type") == "view", "{odd}{user_id}{none}")
        .otherwise("{event_type}: {props}")
    )
    variables = F.create_map(
        F.lit("user_id"),
        F.col("user_id").cast("string"),
        F.lit("event_type"),
        F.col("event_type"),
        F.lit("props"),
        F.col("props"),
        F.lit("odd"),
        F.lit("{v}"),
        F.lit("v"),
        F.lit("wrong"),
        F.lit("none"),
        F.lit(None).cast("string"),
    )
    return table(spark, sf_dir, "events").select("event_id", render.render_column(template, variables).alias("message"))


@query(
    "vars_precedence",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'payload' WHEN event_type = 'view' THEN 'event' ELSE 'job' END
      AS level, CAST(user_id AS VARCHAR) AS owner, CASE WHEN event_type = 'click' THEN 'mine' ELSE CAST(event_id AS VARCHAR) END
      AS id, CAST(user_id + 1 AS VARCHAR) AS attempts FROM events""",
)
def vars_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    job = F.create_map(F.lit("level"), F.lit("job"), F.lit("owner"), F.col("user_id").cast("string"))
    event = F.when(F.col("event_type").isin("error", "view"), F.create_map(F.lit("level"), F.lit("event"))).otherwise(empty)
    payload = (
        F.when(F.col("event_type") == "error", F.create_map(F.lit("level"), F.lit("payload")))
        .when(F.col("event_type") == "click", F.create_map(F.lit("event_id"), F.lit("mine")))
        .otherwise(empty)
    )
    merged = render.event_variables(
        job, event, payload, F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id") + 1
    )
    rows = table(spark, sf_dir, "events").select("event_id", merged.alias("m"))
    return rows.select(
        "event_id",
        F.col("m")["level"].alias("level"),
        F.col("m")["owner"].alias("owner"),
        F.col("m")["event_id"].alias("id"),
        F.col("m")["attempts"].alias("attempts"),
    )


@query(
    "event_ids",
    """SELECT event_id, user_id || ':' || event_type || ':' || CASE WHEN event_type = 'purchase' THEN
      json_extract_string(props, '$.k') || ':' ELSE '' END || epoch_us(ts) // 1000 AS id FROM events""",
)
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.when(F.col("event_type") == "purchase", F.get_json_object("props", "$.k"))
    made = render.event_id(F.col("user_id"), F.col("event_type"), F.col("ts"), step)
    return table(spark, sf_dir, "events").select("event_id", made.alias("id"))


@query(
    "event_key_hash",
    """SELECT event_id, substr(md5('{"k":' || json_extract_string(props, '$.k') || '}'), 1, 16) AS key FROM events""",
)
def event_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = F.to_json(F.from_json("props", "k int"))
    return table(spark, sf_dir, "events").select("event_id", render.event_key(metadata).alias("key"))


@query("stable_hash", "SELECT event_id, sha256(props) AS hash FROM events")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", render.stable_hash(F.col("props")).alias("hash"))


@query(
    "status_report",
    f"""WITH {JOBS_SQL} SELECT job_id, name, attempts, submitted, runtime_job_id, last_status, log_path,
      '- ' || job_id || ' ' || name || ' status=' || coalesce(last_status, 'None') || ' attempts=' || attempts
      || ' submitted=' || CASE WHEN submitted THEN 'True' ELSE 'False' END AS line,
      '{{"job_id":' || job_id || ',"name":"' || name || '","attempts":' || attempts || ',"submitted":' || submitted
      || ',"runtime_job_id":' || coalesce('"' || runtime_job_id || '"', 'null') || ',"last_status":'
      || coalesce('"' || last_status || '"', 'null') || ',"log_path":"' || log_path || '"}}' AS record
    FROM jobs WHERE final_state IS NULL""",
)
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.status_report(jobs(spark, sf_dir))
    record = F.to_json(F.struct(*reports.REPORT_COLUMNS), {"ignoreNullFields": "false"})
    return rows.select("*", reports.status_line().alias("line"), record.alias("record"))


@query("status_counts", f"WITH {JOBS_SQL} SELECT last_status, count(*) AS jobs FROM jobs GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(jobs(spark, sf_dir))


@query(
    "poll_snapshot",
    f"""WITH {JOBS_SQL}, latest AS (SELECT 'r' || l_orderkey AS runtime_job_id,
      arg_max(l_returnflag, (l_shipdate, l_linenumber, l_returnflag)) AS status FROM lineitem GROUP BY 1)
    SELECT job_id, CASE WHEN NOT submitted THEN 'pending' ELSE status END AS state, attempts
    FROM jobs LEFT JOIN latest USING (runtime_job_id) WHERE final_state IS NULL AND attempts <> 3""",
)
def poll_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items stand for the status feed; jobs of priority 3 are about to finish."""
    status = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.max_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_returnflag")).alias("status"))
        .select(F.concat(F.lit("r"), F.col("l_orderkey")).alias("runtime_job_id"), "status")
    )
    return reports.poll_snapshot(jobs(spark, sf_dir), status, F.col("attempts") == 3)


@query(
    "event_rollup",
    """SELECT user_id, event_type, count(*) AS count, min(ts) AS first_seen_ts, max(ts) AS last_seen_ts,
      arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS k, arg_max(big, (ts, event_id)) AS big
    FROM (SELECT *, CASE WHEN value > 50 THEN value END AS big FROM events) GROUP BY 1, 2""",
)
def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload has key ``k`` always and key ``big`` sometimes; the latest value of each stays."""
    rows = table(spark, sf_dir, "events").select(
        "user_id",
        "event_type",
        "ts",
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("value") > 50, F.col("value")).alias("big"),
    )
    return reports.event_rollup(rows, ["user_id", "event_type"], ["ts", "event_id"], {"k": "k", "big": "big"})


@query(
    "event_history",
    "SELECT user_id, event_type, ts, 'value ' || props AS note FROM events WHERE value > 50",
)
def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("value") > 50, F.concat(F.lit("value "), F.col("props")))
    return reports.event_history(table(spark, sf_dir, "events"), ["user_id", "event_type"], note)
