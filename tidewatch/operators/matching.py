"""Log rules against log text: one pass over the text for all rules, no shuffle."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.render import merge_maps
from tidewatch.functions.regex import quote, reads_context, required_literal, to_jvm
from tidewatch.operators.rules import LogRule, active

# Beyond this many distinct patterns the literal plan gets too wide and the join plan takes over.
MAX_LITERAL_PATTERNS = 200
# Up to this many jobs, each job's pattern numbers (at most the above) are sent along with the text.
MAX_SENT_JOBS = 50_000


def _payload(rule: LogRule, match: Column, groups: dict[str, Column]) -> Column:
    """Rule metadata, then match and line, then groups; later entries win."""
    entries: dict[str, Column] = {k: F.lit(v).cast("string") for k, v in rule.metadata.items()}
    entries |= {"match": match, "line": match}
    entries |= groups
    return F.create_map(*[part for key, value in entries.items() for part in (F.lit(key), value)])


def _hit(idx: int, rule: LogRule, seq: Column, match: Column, groups: dict[str, Column], payload: bool) -> Column:
    fields = [
        F.lit(idx).alias("rule_idx"),
        F.lit(rule.name).alias("rule_name"),
        seq.cast("int").alias("match_seq"),
        match.alias("match"),
    ]
    if payload:
        fields.append(_payload(rule, match, groups).alias("payload"))
    return F.struct(*fields)


def _hit_type(payload: bool) -> str:
    tail = ",payload:map<string,string>" if payload else ""
    return f"array<struct<rule_idx:int,rule_name:string,match_seq:int,match:string{tail}>>"


def rule_hits(text: Column, idx: int, rule: LogRule, payload: bool = True) -> Column:
    """Array of the rule's hits in ``text``, in text order."""
    none = F.array().cast(_hit_type(payload))
    numbers = rule.groups() if payload else {}
    optional = rule.optional() if numbers else set()

    def absent(value: Column, number: int) -> Column:
        return F.when(value != "", value) if number in optional else value

    if rule.pattern_type == "substring" and rule.pattern:
        literal = F.lit(rule.pattern)
        groups = {key: literal for key in numbers}

        def whole(seq: Column) -> Column:
            return _hit(idx, rule, seq, literal, groups, payload)

        if rule.match_once:
            hits = F.array(whole(F.lit(0)))
        else:
            removed = F.length(text) - F.length(F.replace(text, literal, F.lit("")))
            count = (removed / F.lit(len(rule.pattern))).cast("int")
            hits = F.transform(F.sequence(F.lit(0), count - 1), whole)
        return F.when(F.contains(text, literal), hits.cast(_hit_type(payload))).otherwise(none)

    pattern = rule.jvm_pattern
    needed = required_literal(rule.pattern) if rule.pattern else None
    guard = F.contains(text, F.lit(needed)) if needed else None
    wanted = sorted(set(numbers.values()) | {0})
    if rule.match_once:
        found = F.regexp_like(text, F.lit(pattern))
        guard = found if guard is None else guard & found
        matches = F.array(F.struct(*[F.regexp_extract(text, pattern, n).alias(f"g{n}") for n in wanted]))
    elif len(wanted) == 1:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    elif not reads_context(rule.pattern):
        # A match that does not look around it matches the same way when it stands alone.
        alone = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        matches = F.transform(
            alone,
            lambda m: F.struct(
                *[(m if n == 0 else F.regexp_extract(m, pattern, n)).alias(f"g{n}") for n in wanted]
            ),
        )
    else:
        lists = [F.regexp_extract_all(text, F.lit(pattern), F.lit(n)).alias(f"g{n}") for n in wanted]
        matches = F.arrays_zip(*lists)

    plain = len(wanted) == 1 and not rule.match_once

    def each(found: Column, seq: Column) -> Column:
        parts = {n: found if plain else found[f"g{n}"] for n in wanted}
        groups = {key: absent(parts[n], n) for key, n in numbers.items()}
        return _hit(idx, rule, seq, parts[0], groups, payload)

    hits = F.transform(matches, each).cast(_hit_type(payload))
    return hits if guard is None else F.when(guard, hits).otherwise(none)


def all_hits(text: Column, rules: Sequence[tuple[int, LogRule]], payload: bool = True) -> Column:
    """Hits of all rules in evaluation order: rule index, then place in the text."""
    arrays = [rule_hits(text, idx, rule, payload) for idx, rule in rules if rule.pattern_type != "inactivity"]
    if not arrays:
        return F.array().cast(_hit_type(payload))
    return F.concat(*arrays)


def _up_to_effect(hits: Column, rules: Sequence[tuple[int, LogRule]]) -> Column:
    """Hits up to the first that surely ends its chunk: a rule with a special effect and no condition."""
    ending = [idx for idx, rule in rules if rule.action.effect != "noop" and rule.condition is None]
    if not ending:
        return hits
    first = F.array_position(F.transform(hits, lambda hit: hit["rule_idx"].isin(ending)), True)
    return F.slice(hits, F.lit(1), F.when(first > 0, first.cast("int")).otherwise(F.size(hits)))


def match_triggers(
    chunks: DataFrame,
    rules: Sequence[LogRule],
    keep: Sequence[str] = ("job_id", "chunk_seq", "ts"),
    payload: bool = True,
    cut_after_effect: bool = False,
) -> DataFrame:
    """One row per hit of each rule that has an action.

    Matching is map-only. ``payload=False`` leaves out the metadata map and skips group extraction.
    ``cut_after_effect`` drops, before any shuffle, hits that a replay would never get to in their chunk.
    """
    chosen = active(list(rules))
    hits = all_hits(F.col("text"), chosen, payload)
    new_text = chunks.filter(F.col("text") != "")
    if cut_after_effect:
        new_text = new_text.withColumn("__hits", hits)
        hits = _up_to_effect(F.col("__hits"), chosen)
    return new_text.select(*keep, F.explode(hits).alias("hit")).select(*keep, "hit.*")


@F.pandas_udf(T.StringType())
def _jvm_patterns(pattern: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([to_jvm(p) if k == "regex" else quote(p) for p, k in zip(pattern, kind)])


@F.pandas_udf(T.StringType())
def _needed_literals(pattern: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([required_literal(p) if k == "regex" else p for p, k in zip(pattern, kind)])


def match_registry_rules(
    chunks: DataFrame,
    rules: DataFrame,
    keep: Sequence[str] = ("chunk_seq", "ts"),
    max_literal_patterns: int = MAX_LITERAL_PATTERNS,
    max_sent_jobs: int = MAX_SENT_JOBS,
    payload: bool = False,
) -> DataFrame:
    """Hits of per-job rules: ``rules(job_id, rule_idx, name, pattern, pattern_type, match_once)``.

    With ``payload`` the rules also have ``metadata`` and ``extract_groups``, and each hit a payload: the rule's metadata,
    then match and line, then the extracted groups, later entries winning.

    Jobs mostly share a few patterns. While the distinct ones are few they are matched as literals in one
    map-only pass and the narrow hits meet the rule table afterwards; if the jobs are few enough to send, a chunk is
    only searched for its own job's patterns. With many patterns, each chunk meets its own job's rules, held in one array,
    and is searched for them within its row, so text moves once at most. Rules whose longest necessary piece the text does not
    hold are passed over before their regex is looked at, so a row compiles few of its job's patterns. Both plans give the same rows: a missing
    ``pattern_type`` is substring, a missing ``match_once`` true, rules without a pattern never match.
    """
    shape = ["pattern", "pattern_type", "match_once", *(["groups"] if payload else [])]
    given = {
        "pattern_type": F.coalesce("pattern_type", F.lit("substring")),
        "match_once": F.coalesce("match_once", F.lit(True)),
    }
    if payload:
        given["groups"] = F.coalesce(F.to_json("extract_groups"), F.lit("{}"))
    usable = rules.withColumns(given).filter(F.col("pattern_type").isin("substring", "regex") & (F.col("pattern") != ""))
    distinct = usable.select(*shape).distinct().limit(max_literal_patterns + 1).collect()
    new_text = chunks.filter(F.col("text") != "").select("job_id", *keep, "text")
    about = [F.col("metadata").alias("rule_metadata")] if payload else []
    wanted = usable.select("job_id", "rule_idx", F.col("name").alias("rule_name"), *shape, *about)
    names = ["rule_metadata"] if payload else []

    if len(distinct) <= max_literal_patterns:
        shapes = sorted(distinct, key=tuple)
        groups = [json.loads(r.groups) if payload else {} for r in shapes]
        literal = [
            (i, LogRule("", r.pattern, r.pattern_type, match_once=r.match_once, extract_groups=groups[i]))
            for i, r in enumerate(shapes)
        ]
        number = F.lit(None).cast("int")
        for i, r in enumerate(shapes):
            same = F.lit(True)
            for column in shape:
                same = same & (F.col(column) == r[column])
            number = F.when(same, i).otherwise(number)
        by_shape = wanted.select("job_id", "rule_idx", "rule_name", *names, number.alias("shape"))
        own = by_shape.groupBy("job_id").agg(F.collect_set("shape").alias("__own"))
        few = own.limit(max_sent_jobs + 1).count() <= max_sent_jobs
        searched = new_text.join(F.broadcast(own), "job_id") if few else new_text
        none = F.array().cast(_hit_type(payload))
        arrays = []
        for i, rule in literal:
            found = rule_hits(F.col("text"), i, rule, payload=payload)
            arrays.append(F.when(F.array_contains("__own", i), found).otherwise(none) if few else found)
        hit = F.explode(F.concat(none, *arrays)).alias("hit")
        hits = searched.select("job_id", *keep, hit).select(
            "job_id",
            *keep,
            F.col("hit.rule_idx").alias("shape"),
            "hit.match_seq",
            "hit.match",
            *(["hit.payload"] if payload else []),
        )
        return hits.join(by_shape, ["job_id", "shape"]).select(
            "job_id", *keep, "rule_idx", "rule_name", "match_seq", "match", *_with_metadata(payload)
        )

    ready = wanted.withColumn("jvm", F.when(F.col("pattern_type") == "regex", _jvm_patterns("pattern", "pattern_type")))
    if payload:
        ready = ready.withColumn("groups", _group_numbers("pattern", "pattern_type", "groups"))
    ready = ready.withColumn("needed", _needed_literals("pattern", "pattern_type"))
    rule = F.struct("rule_idx", "rule_name", "pattern", "jvm", "needed", "match_once", *(["groups"] if payload else []), *names)
    own = ready.groupBy("job_id").agg(F.collect_list(rule).alias("__rules"))
    text = F.col("text")

    def found(r: Column) -> Column:
        length = F.length(text) - F.length(F.replace(text, r["pattern"], F.lit("")))
        times = (length / F.length(r["pattern"])).cast("int")
        literal = F.array_repeat(r["pattern"], F.when(r["match_once"], F.least(times, F.lit(1))).otherwise(times))
        regex = F.regexp_extract_all(text, r["jvm"], F.lit(0))
        regex = F.when(r["match_once"], F.slice(regex, 1, 1)).otherwise(regex)
        matches = F.when(r["jvm"].isNull(), literal).otherwise(regex)
        fields = [r["rule_idx"].alias("rule_idx"), r["rule_name"].alias("rule_name"), matches.alias("m")]
        if payload:
            fields += [r["rule_metadata"].alias("rule_metadata"), _group_values(text, r, matches).alias("g")]
        return F.struct(*fields)

    possible = F.filter("__rules", lambda r: r["needed"].isNull() | F.contains(text, r["needed"]))
    hits = F.filter(F.transform(possible, found), lambda r: F.size(r["m"]) > 0)
    narrow = new_text.join(own, "job_id").select("job_id", *keep, F.inline(hits))
    kept = ["job_id", *keep, "rule_idx", "rule_name"]
    if not payload:
        return narrow.select(*kept, F.posexplode("m").alias("match_seq", "match"))
    each = narrow.select(*kept, "rule_metadata", "g", F.posexplode("m").alias("match_seq", "match"))
    base = F.create_map(F.lit("match"), F.col("match"), F.lit("line"), F.col("match"))
    extracted = F.map_from_entries(
        F.transform("g", lambda g: F.struct(g["key"].alias("k"), F.get(g["values"], F.col("match_seq")).alias("v")))
    )
    full = each.withColumn("payload", merge_maps(base, extracted))
    return full.select(*kept, "match_seq", "match", *_with_metadata(True))


def _with_metadata(payload: bool) -> list[Column]:
    if not payload:
        return []
    own = F.coalesce("rule_metadata", F.create_map().cast("map<string,string>"))
    return [merge_maps(own, F.col("payload")).alias("payload")]


GROUPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("number", T.IntegerType()),
            T.StructField("optional", T.BooleanType()),
        ]
    )
)


@F.pandas_udf(GROUPS)
def _group_numbers(pattern: pd.Series, kind: pd.Series, groups: pd.Series) -> pd.Series:
    def numbers(p: str, k: str, given: str) -> list[dict]:
        rule = LogRule("", p, k, extract_groups=json.loads(given))
        found = rule.groups()
        optional = rule.optional() if found else set()
        return [{"key": key, "number": n, "optional": n in optional} for key, n in found.items()]

    return pd.Series([numbers(*x) for x in zip(pattern, kind, groups)])


def _group_values(text: Column, rule: Column, matches: Column) -> Column:
    """The values of each extracted group over all matches, in order."""

    def values(g: Column) -> Column:
        all_ = F.when(rule["jvm"].isNull(), matches).otherwise(F.regexp_extract_all(text, rule["jvm"], g["number"]))
        seen = F.transform(all_, lambda v: F.when(~(g["optional"] & (v == "")), v))
        return F.struct(g["key"].alias("key"), seen.alias("values"))

    return F.transform(rule["groups"], values)
