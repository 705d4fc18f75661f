"""Quality rules whose cutoffs are chosen so that few good texts are rejected, with a guarantee per stratum.

The cutoffs of all rules form one path per stratum, each step of which makes one rule stricter by one cutoff. Labelled bad
texts order the path: steps that catch many of them come first. Labelled good texts say how many all cutoffs of the path up
to a step would reject together. A stratum goes along its path as long as the exact binomial (Clopper-Pearson) bound on
that rate is within the limit, and stops for good at the first step where it is not. The rates of a path only grow and the
good labels have no part in its order, so the steps need no correction; the confidence is only corrected for the strata.
With few labels the first step fails, and no rule is applied to that stratum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import as_row, bound_once, row_key
from tidewatch.session import materialise

#: Fixed values of the base rules.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RUN = 8
LEAST_WORDS = 20
MOST_REPEATED = 30


@dataclass(frozen=True)
class Rule:
    """A text is rejected when ``over / of`` is above the cutoff; cutoffs from strict to loose."""

    name: str
    over: str
    of: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)),
    Rule("repeated_words", "n_repeat_words", "n_words", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25)),
    Rule("capitals", "n_capitals", "word_chars", (0.1, 0.2, 0.3, 0.4, 0.5)),
)
#: Share of good texts of a stratum that all rules together may reject, and the chance that the guarantee fails anywhere.
RISK = 0.01
FAILURE = 0.05


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def repeated_words(words: Column) -> Column:
    """Words that lie in a run of RUN words found twice or more, all finds included.

    Runs are proposed by hashes, sorted with their places in one pass over numbers, and confirmed by their words.
    """
    runs = F.size(words) - (RUN - 1)

    def proposed(hashes: Column) -> Column:
        bits = F.length(F.bin(runs))

        def key(i: Column) -> Column:
            return F.call_function("shiftleft", F.xxhash64(F.slice(hashes, i + 1, RUN)), bits).bitwiseOR(i.cast("bigint"))

        def twice(keys: Column) -> Column:
            head = lambda x: F.call_function("shiftrightunsigned", x, bits)
            same = lambda x, j: F.coalesce(head(x) == head(F.get(keys, j)), F.lit(False))
            found = F.filter(keys, lambda x, j: same(x, j - 1) | same(x, j + 1))
            mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
            return F.transform(found, lambda x: x.bitwiseAND(mask).cast("int"))

        return bound_once(F.sort_array(F.transform(F.sequence(F.lit(0), runs - 1), key)), twice)

    def confirmed(places: Column) -> Column:
        texts = F.transform(places, lambda p: F.struct(F.array_join(F.slice(words, p + 1, RUN), " ").alias("w"), p.alias("p")))

        def twice(rows: Column) -> Column:
            same = lambda x, j: F.coalesce(x["w"] == F.get(rows, j)["w"], F.lit(False))
            found = F.filter(rows, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.sort_array(F.transform(found, lambda x: x["p"]))

        return bound_once(F.sort_array(texts), twice)

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-RUN).alias("last"))
    cover = lambda places: F.aggregate(
        places,
        start,
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(RUN), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    places = bound_once(bound_once(hashes, proposed), confirmed)
    return F.when(runs < 2, F.lit(0).cast("bigint")).otherwise(cover(places))


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, _id, _x, stratum, counts, base_failed) of every whole text; a null text has no words, a null stratum is one."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), *row_key(docs, text), F.coalesce(docs[stratum].cast("string"), F.lit("")).alias("stratum"), text.alias("_t")
    )
    text = F.col("_t")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    counted = bound_once(
        words,
        lambda ws: F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            repeated_words(ws).alias("n_repeat_words"),
        ),
    )
    of_lines = bound_once(
        lines,
        lambda ls: F.struct(
            F.size(ls).cast("bigint").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines")
        ),
    )
    out = rows.select(
        "doc_id",
        "_id",
        "_x",
        "stratum",
        counted.alias("_w"),
        of_lines.alias("_l"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        _count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
    )
    out = out.select("doc_id", "_id", "_x", "stratum", "_w.*", "_l.*", "word_chars", "n_symbols", "n_capitals")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _over(rule: Rule, cutoff: Column) -> Column:
    """Whether a row is above a cutoff; multiplied out, so that a text without words is not."""
    return F.coalesce(F.col(rule.over) > cutoff * F.col(rule.of), F.lit(False))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Binomial(n, p), summed in logarithms term by term."""
    odds = F.lit(p / (1 - p))
    first = n * F.log1p(F.lit(-p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1) / i * odds)
        return F.struct(term.alias("t"), (acc["s"] + F.log1p(F.exp(term - acc["s"]))).alias("s"))

    start = F.struct(first.alias("t"), first.alias("s"))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, add, lambda acc: F.exp(acc["s"]))


def _steps(rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(level, rule, cutoffs at least exceeded by a text it rejects) of every step; level 1 is the loosest cutoff of a rule."""
    return [(j, r, len(rule.cutoffs) - j + 1) for r, rule in enumerate(rules) for j in range(1, len(rule.cutoffs) + 1)]


def _patterns(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(stratum, over, n): how many texts exceed how many cutoffs of each rule. Few rows, however many texts."""
    over = [sum((_over(rule, F.lit(c)).cast("int") for c in rule.cutoffs), F.lit(0)) for rule in rules]
    return found.groupBy("stratum", F.array(*over).alias("over")).agg(F.count("*").alias("n"))


def _paths(bad: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(stratum, path) from the patterns of bad texts: most caught first, never a rule's stricter cutoff before a looser one."""
    steps = _steps(rules)
    caught = {(r, j): F.sum(F.when(F.get("over", F.lit(r)) == need, F.col("n")).otherwise(0)) for j, r, need in steps}
    least = lambda r, j: F.least(*[caught[r, i] for i in range(1, j + 1)]) if j > 1 else caught[r, 1]
    return bad.groupBy("stratum").agg(F.sort_array(F.array(*[_step(-least(r, j), j, r, n) for j, r, n in steps])).alias("path"))


def _step(rank: Column, level: int, rule: int, need: int) -> Column:
    return F.struct(rank.cast("bigint").alias("rank"), *[F.lit(x).alias(c) for x, c in ((level, "level"), (rule, "rule"), (need, "need"))])


def controlled_cutoffs(
    good: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, failure: float = FAILURE, bad: DataFrame | None = None
) -> DataFrame:
    """(stratum, one cutoff column per rule, null where none qualifies) from the measures of labelled good texts.

    All rules together may falsely reject ``risk``; each stratum has the confidence 1 - failure / strata (Bonferroni), so
    all of them hold at once with a chance of 1 - failure. A stratum needs ln(strata / failure) / -ln(1 - risk) good labels
    at least. ``bad`` has the measures of labelled bad texts; without any in a stratum all rules get stricter by turns.
    """
    steps = _steps(rules)
    table = materialise(_patterns(good, rules), "good-patterns")
    level = failure / max(1, table.select("stratum").distinct().count())
    by_turns = F.sort_array(F.array(*[_step(F.lit(0), j, r, n) for j, r, n in steps]))
    if bad is None:
        walked = table.withColumn("path", by_turns)
    else:
        paths = materialise(_paths(_patterns(bad, rules), rules), "cutoff-paths")
        walked = table.join(paths, "stratum", "left").withColumn("path", F.coalesce("path", by_turns))
    first = F.array_position(F.transform("path", lambda s: F.get("over", s["rule"]) >= s["need"]), True)
    walked = walked.withColumn("first", first)
    hits = [F.sum(F.when(F.col("first").between(1, p), F.col("n")).otherwise(0)) for p in range(1, len(steps) + 1)]
    counts = walked.groupBy("stratum").agg(F.first("path").alias("path"), F.sum("n").alias("n"), F.array(*hits).alias("hits"))
    within = lambda h: (h < F.col("n") * risk) & (binomial_cdf(h, F.col("n"), risk) <= level)
    failed = F.array_position(F.transform("hits", within), False)
    taken = F.when(failed == 0, F.col("path")).otherwise(F.slice("path", 1, (failed - 1).cast("int")))
    counts = materialise(counts.select("stratum", taken.alias("taken")), "steps-taken")

    def chosen(r: int, rule: Rule) -> Column:
        strictness = F.size(F.filter("taken", lambda s: s["rule"] == r))
        return F.get(F.array(*map(F.lit, rule.cutoffs)), len(rule.cutoffs) - strictness).alias(rule.name)

    return counts.select("stratum", *[chosen(r, rule) for r, rule in enumerate(rules)])


def quality_verdicts(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, stratum: str = "lang") -> DataFrame:
    """The measures of every row with ``kept``: false when a base rule fails or a rule with a cutoff is above it.

    ``labels`` has doc_id and quality (1 good, 0 bad, null unknown); repeated labels count once and a document labelled both
    ways is taken for bad. Documents without text fail the base rules. Empty tables give no rows.
    """
    found = materialise(measures(docs, stratum), "measures")
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.min("quality").alias("_q"))
    good, bad = (found.join(marks.filter(F.col("_q") == q), "_id", "left_semi").filter(~F.col("base_failed")) for q in (1, 0))
    cutoffs = materialise(controlled_cutoffs(good, rules, bad=bad), "cutoffs")
    bad = F.col("base_failed")
    for rule in rules:
        bad = bad | _over(rule, F.col(rule.name))
    return found.join(cutoffs, "stratum", "left").select(*found.columns, (~bad).alias("kept"))


def without_bad(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    rejected = quality_verdicts(docs, labels).filter(~F.col("kept")).select("_id", "_x")
    rows = docs.select(as_row(docs), *row_key(docs, F.coalesce(docs["text"], F.lit(""))))
    return rows.join(rejected, ["_id", "_x"], "left_anti").select("_row.*")
