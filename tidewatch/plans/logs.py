"""Queries on log text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.actions import Action, action_results, job_requests
from tidewatch.operators.matching import match_registry_rules, match_triggers
from tidewatch.operators.rules import LogRule, active
from tidewatch.plans.tables import document_chunks, query, sql_text, table, turn_chunks
from tidewatch.session import scratch_path
from tidewatch.sources import tail
from tidewatch.sources.logs import log_increments
from tidewatch.sources.sinks import message_rows

NOTE = Action("LogAction", "{job_id}: {match}", level="INFO")
IPV4 = r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})"

DOCUMENT_RULES = [
    LogRule("license", "License", action=NOTE),
    LogRule("heading", "###", match_once=False, action=Action("LogAction", "{rule_name} in {job_id} {x}", level="WARNING")),
    LogRule("silent", "the"),
    LogRule(
        "token",
        r'token = "([0-9a-f]+)"',
        "regex",
        extract_groups={"token": 1, "lost": 9},
        action=Action("NewJobAction", job_config="rotate"),
    ),
    LogRule("address", IPV4, "regex", extract_groups={"second": 2}, match_once=False, action=Action("CancelAction", "address")),
    LogRule(
        "released",
        r"Released under the (?P<kind>[A-Z]+) License",
        "regex",
        extract_groups={"kind": "kind", "full": "match"},
        metadata={"team": "legal"},
        action=Action("FinishAction", "released"),
    ),
    LogRule("line_end", r"\.$", "regex", match_once=False, action=Action("RestartAction", "full stop")),
]
TURN_RULES = [
    LogRule("capital", r"^([A-Z][a-z]+)", "regex", match_once=False, extract_groups={"word": 1}, action=NOTE),
    LogRule("line_end", r"\.$", "regex", match_once=False, action=NOTE),
    LogRule("ending", "tion", match_once=False, action=NOTE),
]


def _sql_pattern(rule: LogRule) -> str:
    if rule.pattern_type == "substring":
        return "".join("\\" + c if c in r"\.^$|()[]{}*+?#" else c for c in rule.pattern)
    return "(?m)" + rule.pattern.replace("(?P<kind>", "(")


def _hits_sql(idx: int, rule: LogRule, source: str, keys: str, group: int = 0) -> str:
    pattern = sql_text(_sql_pattern(rule))
    cut = "[1:1]" if rule.match_once else ""
    return f"""SELECT {keys}, {idx} AS rule_idx, {sql_text(rule.name)} AS rule_name,
      CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS match_seq, unnest(m) AS match, unnest(g) AS grp
    FROM (SELECT *, regexp_extract_all(text, {pattern}, 0){cut} AS m,
      regexp_extract_all(text, {pattern}, {group}){cut} AS g FROM {source}) WHERE len(m) > 0"""


def _all_hits_sql(rules: list[LogRule], source: str, keys: str) -> str:
    parts = []
    for idx, rule in active(rules):
        numbers = [n for n in rule.groups().values() if n]
        parts.append(_hits_sql(idx, rule, source, keys, numbers[0] if numbers else 0))
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


DOCUMENTS = "(SELECT doc_id AS job_id, text FROM documents WHERE text <> '')"
TURNS = "(SELECT conv_id AS job_id, turn AS chunk_seq, text FROM conversations WHERE text <> '')"
DOCUMENT_HITS_SQL = _all_hits_sql(DOCUMENT_RULES, DOCUMENTS, "job_id")
TURN_HITS_SQL = _all_hits_sql(TURN_RULES, TURNS, "job_id, chunk_seq")


def document_hits(spark: SparkSession, sf_dir: str, payload: bool = True) -> DataFrame:
    return match_triggers(document_chunks(spark, sf_dir), DOCUMENT_RULES, ["job_id"], payload)


@query(
    "log_triggers",
    f"""WITH {DOCUMENT_HITS_SQL} SELECT job_id, rule_idx, rule_name, match_seq, match,
      CASE WHEN rule_name IN ('token', 'address', 'released') THEN grp END AS grp FROM hits""",
)
def log_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.col("payload")
    return document_hits(spark, sf_dir).select(
        "job_id",
        "rule_idx",
        "rule_name",
        "match_seq",
        "match",
        F.coalesce(payload["token"], payload["second"], payload["kind"]).alias("grp"),
    )


@query(
    "log_substring",
    f"WITH {TURN_HITS_SQL} SELECT job_id, chunk_seq, match_seq, match FROM hits WHERE rule_name = 'ending'",
)
def log_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match_triggers(turn_chunks(spark, sf_dir), TURN_RULES[2:], ["job_id", "chunk_seq"], payload=False)
    return rows.select("job_id", "chunk_seq", "match_seq", "match")


@query(
    "log_regex",
    f"WITH {TURN_HITS_SQL} SELECT job_id, chunk_seq, rule_idx, match_seq, match FROM hits WHERE rule_name <> 'ending'",
)
def log_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match_triggers(turn_chunks(spark, sf_dir), TURN_RULES[:2], ["job_id", "chunk_seq"], payload=False)
    return rows.select("job_id", "chunk_seq", "rule_idx", "match_seq", "match")


@query(
    "log_groups",
    f"""WITH {DOCUMENT_HITS_SQL} SELECT job_id, match_seq, match, match AS line,
      CASE WHEN rule_name = 'token' THEN grp END AS token, CASE WHEN rule_name = 'released' THEN grp END AS kind,
      CASE WHEN rule_name = 'released' THEN match END AS "full",
      CASE WHEN rule_name = 'released' THEN 'legal' END AS team, CAST(NULL AS VARCHAR) AS lost
    FROM hits WHERE rule_name IN ('token', 'released')""",
)
def log_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [rule for rule in DOCUMENT_RULES if rule.name in ("token", "released")]
    rows = match_triggers(document_chunks(spark, sf_dir), rules, ["job_id"])
    keys = ("line", "token", "kind", "full", "team", "lost")
    return rows.select("job_id", "match_seq", "match", *[F.col("payload")[key].alias(key) for key in keys])


@query(
    "log_match_once",
    f"""WITH {TURN_HITS_SQL} SELECT job_id, chunk_seq, rule_idx, match FROM hits WHERE match_seq = 0""",
)
def log_match_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        LogRule(r.name, r.pattern, r.pattern_type, r.action, extract_groups=r.extract_groups) for r in TURN_RULES
    ]
    rows = match_triggers(turn_chunks(spark, sf_dir), rules, ["job_id", "chunk_seq"], payload=False)
    return rows.select("job_id", "chunk_seq", "rule_idx", "match")


@query(
    "log_increment",
    """SELECT doc_id AS job_id, md5(substr(text, n_chars // 2 + 1)) AS new_text_md5,
      length(substr(text, n_chars // 2 + 1)) AS new_chars, strlen(text) AS log_cursor FROM documents""",
)
def log_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    logs = docs.select(F.col("doc_id").alias("job_id"), "text")
    read = F.octet_length(F.expr("substring(text, 1, cast(n_chars div 2 as int))"))
    cursors = docs.select(F.col("doc_id").alias("job_id"), read.alias("log_cursor"))
    return log_increments(logs, cursors).select(
        "job_id",
        F.md5("new_text").alias("new_text_md5"),
        F.length("new_text").cast("long").alias("new_chars"),
        "log_cursor",
    )


#: Bytes of a range: small, so that the files here are cut into several.
RANGE_BYTES = 1 << 16


@query(
    "log_increment_files",
    """WITH d AS (SELECT coalesce(source, 'none') AS source, doc_id, coalesce(text, '') AS text, doc_id * 2 >= max(doc_id) OVER () AS fresh FROM documents),
    lines AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM d WHERE fresh),
    sums AS (SELECT source, count(*) AS new_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS new_bytes,
      CAST(sum(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT)) AS BIGINT) AS line_hashes FROM lines GROUP BY source)
    SELECT source AS job_id, new_lines, new_bytes, line_hashes, CAST(sum(strlen(text) + 1) AS BIGINT) AS log_cursor
    FROM sums JOIN d USING (source) GROUP BY ALL""",
)
def log_increment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log file per source, read behind a cursor in it: what is new, line by line, and the next cursor."""
    folder = scratch_path(spark, "log-files")
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    logs = files.select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("job_id"), "path")
    old = docs.withColumn("last", F.lit(docs.agg(F.max("doc_id")).first()[0])).filter(F.col("doc_id") * 2 < F.col("last"))
    cursors = old.groupBy(F.col("source").alias("job_id")).agg(F.sum(F.octet_length("text") + 1).alias("log_cursor"))
    read = tail.new_text(logs, cursors, RANGE_BYTES)
    lines = read.select("job_id", "log_cursor", F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("job_id").agg(
        F.count("*").alias("new_lines"),
        F.sum(F.octet_length("line") + 1).alias("new_bytes"),
        F.sum(F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("bigint")).alias("line_hashes"),
        F.max("log_cursor").alias("log_cursor"),
    )


def _variables():
    job = F.create_map(F.lit("job_id"), F.col("job_id").cast("string"), F.lit("rule_name"), F.col("rule_name"))
    return F.map_concat(job, F.map_filter("payload", lambda k, _: ~k.isin("job_id", "rule_name")))


MESSAGE_SQL = """CASE rule_name WHEN 'license' THEN job_id || ': ' || match
      WHEN 'heading' THEN rule_name || ' in ' || job_id || ' {x}' WHEN 'token' THEN 'Submitting local command job'
      WHEN 'address' THEN 'address' WHEN 'released' THEN 'released' ELSE 'full stop' END"""


@query(
    "action_results",
    f"""WITH {DOCUMENT_HITS_SQL} SELECT job_id, rule_idx, match_seq,
      CASE rule_name WHEN 'license' THEN 'noop' WHEN 'heading' THEN 'noop' WHEN 'token' THEN 'noop'
        WHEN 'address' THEN 'cancel' WHEN 'released' THEN 'finish' ELSE 'restart' END AS effect,
      CASE rule_name WHEN 'license' THEN 'continue' WHEN 'heading' THEN 'continue' WHEN 'token' THEN 'continue'
        WHEN 'address' THEN 'cancelled' WHEN 'released' THEN 'finished' ELSE 'restart' END AS outcome,
      'success' AS status, {MESSAGE_SQL} AS message FROM hits""",
)
def action_results_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = action_results(document_hits(spark, sf_dir), active(DOCUMENT_RULES), _variables())
    return done.select("job_id", "rule_idx", "match_seq", "effect", "outcome", "status", "message")


@query(
    "action_messages",
    f"""WITH {DOCUMENT_HITS_SQL} SELECT job_id, CASE rule_name WHEN 'license' THEN 'info' ELSE 'warning' END AS level,
      {MESSAGE_SQL} AS message FROM hits WHERE rule_name IN ('license', 'heading')""",
)
def action_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [rule for rule in DOCUMENT_RULES if rule.action is not None and rule.action.kind == "LogAction"]
    hits = match_triggers(document_chunks(spark, sf_dir), rules, ["job_id"])
    done = action_results(hits.withColumn("ts", F.lit(None).cast("timestamp")), active(rules), _variables())
    return message_rows(done).drop("ts")


@query(
    "new_job_requests",
    f"""WITH {DOCUMENT_HITS_SQL} SELECT job_id, rule_name, 'rotate' AS job_config, grp AS token
    FROM hits WHERE rule_name = 'token'""",
)
def new_job_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    makers = [rule for rule in DOCUMENT_RULES if rule.action is not None and rule.action.kind == "NewJobAction"]
    hits = match_triggers(document_chunks(spark, sf_dir), makers, ["job_id"])
    asked = job_requests(hits, active(makers))
    return asked.select("job_id", "rule_name", "job_config", F.col("payload")["token"].alias("token"))


JOB_RULES = {
    "fr": [("greeting", "Le", "substring", True), ("stop", r"\.$", "regex", False)],
    "de": [("number", "[0-9]+", "regex", False)],
    "en": [("greeting", "The", "substring", True), ("number", "[0-9]+", "regex", False)],
}


def _lang_rules(docs: DataFrame) -> DataFrame:
    """Each document's own rules, by its language."""
    lists = F.lit(None).cast("array<struct<name:string,pattern:string,pattern_type:string,match_once:boolean>>")
    for lang, rules in JOB_RULES.items():
        made = F.array(
            *[
                F.struct(
                    F.lit(n).alias("name"),
                    F.lit(p).alias("pattern"),
                    F.lit(t).alias("pattern_type"),
                    F.lit(o).alias("match_once"),
                )
                for n, p, t, o in rules
            ]
        )
        lists = F.when(F.col("lang") == lang, made).otherwise(lists)
    rows = docs.select(F.col("doc_id").alias("job_id"), F.posexplode(lists).alias("rule_idx", "r"))
    return rows.select("job_id", "rule_idx", "r.*")


def _lang_rules_sql() -> str:
    parts = []
    for lang, rules in JOB_RULES.items():
        for idx, (name, pattern, kind, once) in enumerate(rules):
            source = f"(SELECT doc_id AS job_id, text FROM documents WHERE lang = '{lang}')"
            parts.append(_hits_sql(idx, LogRule(name, pattern, kind, match_once=once), source, "job_id"))
    return " UNION ALL ".join(parts)


@query(
    "log_triggers_by_job",
    f"SELECT job_id, rule_idx, rule_name, match_seq, match FROM ({_lang_rules_sql()})",
)
def log_triggers_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return match_registry_rules(document_chunks(spark, sf_dir), _lang_rules(docs), [])
