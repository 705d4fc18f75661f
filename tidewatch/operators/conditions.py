"""Conditions as trees of driver-side values, compiled to columns.

Every condition gives a pass flag that is never NULL and a message. Those that only read the row, its markers or
an aggregate of its group compile to columns here. Cooldowns depend on earlier firings and run in the replay.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.regex import glob_to_jvm, to_jvm
from tidewatch.functions.render import parse_template, render
from tidewatch.operators.ordered import DEFAULT_LIMIT, attach, last_known, previous, running_sum

_custom: dict[str, Callable[[Custom, Scope], tuple[Column, Column]]] = {}


@dataclass(frozen=True)
class Scope:
    """Columns a condition may read."""

    ts: Column | None = None
    first_ts: Column | None = None
    attempts: Column | None = None
    metadata: Column | None = None
    payload: Column | None = None
    variables: Mapping[str, Column] | Column = field(default_factory=dict)
    marker: Mapping[int, Column] = field(default_factory=dict)


@dataclass(frozen=True, kw_only=True)
class Condition:
    """Base of all conditions. The latch flags count at the top of a tree only."""

    persistent_pass: bool = False
    persistent_fail: bool = False

    stateful = False

    def children(self) -> tuple[Condition, ...]:
        return ()

    def compile(self, scope: Scope) -> tuple[Column, Column]:
        raise NotImplementedError


@dataclass(frozen=True, kw_only=True)
class AlwaysTrue(Condition):
    message: str = ""

    def compile(self, scope: Scope) -> tuple[Column, Column]:
        return F.lit(True), F.lit(self.message)


@dataclass(frozen=True, kw_only=True)
class MaxAttempts(Condition):
    max_attempts: int = 1
    stateful = True

    def compile(self, scope: Scope) -> tuple[Column, Column]:
        passed = F.coalesce(scope.attempts < self.max_attempts, F.lit(False))
        text = F.format_string(f"attempts %s >= limit {self.max_attempts}", scope.attempts.cast("string"))
        return passed, F.when(passed, "").otherwise(text)


@dataclass(frozen=True, kw_only=True)
class Cooldown(Condition):
    """Passes once ``cooldown_seconds`` have gone by since this rule last fired."""

    cooldown_seconds: float = 60.0
    stateful = True

    def compile(self, scope: Scope) -> tuple[Column, Column]:
        raise ValueError("a cooldown depends on earlier firings; use the replay")


@dataclass(frozen=True, kw_only=True)
class Timeout(Condition):
    """Passes until ``timeout_seconds`` after the first evaluation, and no longer from then on."""

    timeout_seconds: float = 600.0
    message: str = "timeout waiting for condition"
    stateful = True

    def compile(self, scope: Scope) -> tuple[Column, Column]:
        elapsed = seconds(scope.ts) - seconds(scope.first_ts)
        passed = F.coalesce(elapsed < F.lit(float(self.timeout_seconds)), F.lit(True))
        left = F.format_string(
            self.message.replace("%", "%%") + " (%.1fs remaining)", F.lit(float(self.timeout_seconds)) - elapsed
        )
        return passed, F.when(passed, F.coalesce(left, F.lit(self.message))).otherwise(self.message)


@dataclass(frozen=True, kw_only=True)
class Metadata(Condition):
    """Tests one metadata key. Values compare by type: the number 5 is not the text "5".

    The map's values are JSON texts when ``typed`` is set and plain strings otherwise.
    """

    key: str = ""
    equals: Any = None
    within: tuple[Any, ...] | None = None
    read: str = "metadata"
    typed: bool = False

    def _same(self, value: Column, wanted: Any) -> Column:
        if self.typed:
            parsed = F.try_parse_json(value)
            kind = F.schema_of_variant(parsed)
            if isinstance(wanted, bool):
                return (kind == "BOOLEAN") & (F.try_variant_get(parsed, "$", "boolean") == wanted)
            if isinstance(wanted, (int, float)):
                numeric = ~kind.isin("STRING", "BOOLEAN", "VOID")
                return numeric & (F.try_variant_get(parsed, "$", "double") == float(wanted))
            return (kind == "STRING") & (F.try_variant_get(parsed, "$", "string") == wanted)
        return value == wanted if isinstance(wanted, str) else F.lit(False)

    def compile(self, scope: Scope) -> tuple[Column, Column]:
        if not self.key:
            return F.lit(False), F.lit("metadata key missing")
        value = F.element_at(scope.payload if self.read == "payload" else scope.metadata, self.key)
        present = value.isNotNull() & (value != "null") if self.typed else value.isNotNull()
        checks = [(present, f"metadata key '{self.key}' not present")]
        if self.equals is not None:
            checks.append((self._same(value, self.equals), f"metadata key '{self.key}' != {self.equals!r}"))
        if self.within is not None:
            inside = F.lit(False)
            for item in self.within:
                inside = inside | F.coalesce(self._same(value, item), F.lit(False))
            checks.append((inside, f"metadata key '{self.key}' not in {list(self.within)!r}"))
        passed, message = F.lit(True), F.lit("")
        for ok, text in reversed(checks):
            ok = F.coalesce(ok, F.lit(False))
            passed, message = ok & passed, F.when(ok, message).otherwise(text)
        return passed, message


class _Marker(Condition):
    """Reads a flag that :func:`attach_markers` joined to the row."""

    def template(self) -> str:
        raise NotImplementedError

    def compile(self, scope: Scope) -> tuple[Column, Column]:
        passed = F.coalesce(scope.marker[id(self)], F.lit(False))
        return passed, F.when(passed, "").otherwise(self.failure(scope))

    def failure(self, scope: Scope) -> Column:
        raise NotImplementedError


@dataclass(frozen=True, kw_only=True)
class FileExists(_Marker):
    path: str = ""

    def template(self) -> str:
        return self.path

    def failure(self, scope: Scope) -> Column:
        return F.concat(F.lit("file "), render(self.path, scope.variables), F.lit(" missing"))


@dataclass(frozen=True, kw_only=True)
class GlobExists(_Marker):
    pattern: str = ""
    min_matches: int = 1

    def template(self) -> str:
        return self.pattern

    def failure(self, scope: Scope) -> Column:
        return F.concat(F.lit("glob "), render(self.pattern, scope.variables), F.lit(" missing"))


@dataclass(frozen=True, kw_only=True)
class FileContent(_Marker):
    path: str = ""
    pattern: str = ""
    mode: str = "contains"

    def __post_init__(self) -> None:
        if self.mode not in ("contains", "regex"):
            raise ValueError("mode must be contains or regex")

    def template(self) -> str:
        return self.path

    def test(self, content: Column) -> Column:
        if self.mode == "contains":
            return F.contains(content, F.lit(self.pattern))
        return F.regexp_like(content, F.lit(to_jvm(self.pattern, multiline=False)))

    def failure(self, scope: Scope) -> Column:
        path = render(self.path, scope.variables)
        missing = scope.marker[id(self)].isNull()
        tail = F.when(missing, " missing").otherwise(" content match failed")
        return F.concat(F.lit("file "), path, tail)


@dataclass(frozen=True, kw_only=True)
class Composite(Condition):
    """All or any of the children; the message is that of the first child that fails."""

    mode: str = "all"
    conditions: tuple[Condition, ...] = ()

    def children(self) -> tuple[Condition, ...]:
        return tuple(self.conditions)

    def compile(self, scope: Scope) -> tuple[Column, Column]:
        parts = [child.compile(scope) for child in self.conditions]
        passed = F.lit(self.mode == "all")
        for ok, _ in parts:
            passed = passed & ok if self.mode == "all" else passed | ok
        text = F.lit("" if self.mode == "all" else "all child conditions failed")
        for ok, message in reversed(parts):
            text = F.when(~ok, message).otherwise(text)
        return passed, F.when(passed, "").otherwise(text)


def And(*conditions: Condition, **flags: bool) -> Composite:
    return Composite(mode="all", conditions=conditions, **flags)


def Or(*conditions: Condition, **flags: bool) -> Composite:
    return Composite(mode="any", conditions=conditions, **flags)


@dataclass(frozen=True, kw_only=True)
class Not(Condition):
    condition: Condition

    def children(self) -> tuple[Condition, ...]:
        return (self.condition,)

    def compile(self, scope: Scope) -> tuple[Column, Column]:
        passed, message = self.condition.compile(scope)
        return ~passed, F.when(passed, F.concat(F.lit("NOT condition failed: child "), message)).otherwise("")


@dataclass(frozen=True, kw_only=True)
class Custom(Condition):
    """A condition added with :func:`register_condition`."""

    kind: str
    options: Mapping[str, Any] = field(default_factory=dict)

    def compile(self, scope: Scope) -> tuple[Column, Column]:
        passed, message = _custom[self.kind](self, scope)
        return F.coalesce(passed, F.lit(False)), message


def register_condition(name: str, builder: Callable[[Custom, Scope], tuple[Column, Column]]) -> None:
    """Add a condition class; ``builder(condition, scope)`` gives pass and message expressions."""
    _custom[name] = builder


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, with microseconds."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def walk(condition: Condition):
    yield condition
    for child in condition.children():
        yield from walk(child)


def uses(condition: Condition | None, *kinds: type) -> bool:
    return condition is not None and any(isinstance(node, kinds) for node in walk(condition))


def attach_markers(
    rows: DataFrame,
    condition: Condition,
    markers: DataFrame,
    variables: Mapping[str, Column] | Column,
    at: str | None = None,
    limit: int = DEFAULT_LIMIT,
) -> tuple[DataFrame, dict[int, Column]]:
    """Join what each marker condition of the tree needs to ``rows``.

    Returns the wider rows and, per condition, the column with its flag: NULL where the file is missing.
    Without ``at`` the markers are what is there now. With ``at``, the rows' time column, ``markers(path, content, ts)``
    are versions (``present`` false for a removal) and each row sees the files as they were at its time.
    """
    flags: dict[int, Column] = {}
    for node in walk(condition):
        if not isinstance(node, _Marker) or id(node) in flags:
            continue
        name = f"__marker_{len(flags)}"
        path = f"{name}_path"
        rows = rows.withColumn(path, render(node.template(), variables))
        if isinstance(node, GlobExists):
            join = _glob_now if at is None else _glob_then
            rows = join(rows, node, markers, name, path, *([] if at is None else [at, limit]))
        else:
            test = F.lit(True) if isinstance(node, FileExists) else node.test(F.col("content"))
            if at is None:
                rows = _file_now(rows, markers, test, name, path)
            else:
                rows = _file_then(rows, markers, test, name, path, at, limit)
        rows = rows.drop(path)
        flags[id(node)] = F.col(name)
    return rows, flags


def _file_now(rows: DataFrame, markers: DataFrame, test: Column, name: str, path: str) -> DataFrame:
    """One row per path on the marker side, so rows never multiply."""
    flag = F.max_by(test, F.col("ts")) if "ts" in markers.columns else F.max(test)
    latest = markers.groupBy(F.col("path").alias(path)).agg(flag.alias(name))
    return rows.join(latest, path, "left")


def _present(markers: DataFrame) -> Column:
    return F.coalesce("present", F.lit(True)) if "present" in markers.columns else F.lit(True)


def _file_then(
    rows: DataFrame, markers: DataFrame, test: Column, name: str, path: str, at: str, limit: int
) -> DataFrame:
    """Latest version of the path at or before the row's time, on one time line per path."""
    seen = F.struct(F.when(_present(markers), test).alias("flag"))
    versions = markers.select(
        F.col("path").alias("__key"), F.col("ts").alias("__at"), F.lit(0).alias("__kind"), seen.alias("__seen")
    )
    line = _lay_in(rows, [path], at, versions)
    known = last_known(line, ["__key"], ["__at", "__kind"], F.col("__seen"), "__known", limit)
    return _take_out(known, rows.columns, F.col("__known.flag").alias(name))


def _lay_in(rows: DataFrame, keys: list[str], at: str, versions: DataFrame) -> DataFrame:
    """Rows and versions on one time line; a version comes before a row of the same instant."""
    key = F.col(keys[0]) if len(keys) == 1 else F.to_json(F.struct(*keys))
    mine = rows.select(
        key.alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*rows.columns).alias("__row")
    )
    return mine.unionByName(versions, allowMissingColumns=True)


def _take_out(line: DataFrame, columns: list[str], *made: Column) -> DataFrame:
    back = [F.col("__row")[c].alias(c) for c in columns]
    return line.filter(F.col("__kind") == 1).select(*back, *made)


#: Wildcards of a glob segment, and the characters of a piece that globs and files are met by.
GLOB_WILD = r"(?:\[!?+\]?+[^\]]*+\]|[*?])"
PIECE = 3


def _in_folder(files: DataFrame) -> DataFrame:
    folder = F.regexp_extract("path", r"(?s)^(.*)/", 1)
    base = F.regexp_extract("path", r"(?s)([^/]*)$", 1)
    return files.withColumns({"__dir": folder, "__base": base})


def _meet_globs(rows: DataFrame, node: GlobExists, files: DataFrame, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows with the key of their glob, and the files that fit each glob.

    A last segment without variables filters the files before they are grouped by folder. One with variables is looked
    up by a piece of up to PIECE characters of its longest literal stretch: files are listed under all their pieces of such
    lengths, so a glob only meets files of its folder that hold its piece, once per distinct pattern. Only patterns
    without any literal character, few as distinct ones, meet a folder's files all.
    """
    last = node.pattern.rsplit("/", 1)[-1]
    rows = rows.withColumn("__dir", F.regexp_extract(path, r"(?s)^(.*)/", 1))
    files = _in_folder(files)
    if all(kind == "text" for kind, _ in parse_template(last)):
        return rows, files.filter(F.regexp_like("__base", F.lit(glob_to_jvm(last)))), ["__dir"]
    rows = rows.withColumn("__glob", F.regexp_extract(path, r"(?s)([^/]*)$", 1))
    stretches = F.transform(F.split("__glob", GLOB_WILD), lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))
    piece = F.substring(F.array_max(stretches)["s"], 1, PIECE)
    globs = rows.select("__dir", "__glob").distinct().withColumn("__piece", piece)
    lengths = globs.select(F.collect_set(F.length("__piece"))).scalar()
    every = F.flatten(F.transform("__lens", lambda n: _pieces(F.col("__base"), n)))
    listed = files.withColumn("__lens", lengths).withColumn("__piece", F.explode(F.array_distinct(every))).drop("__lens")
    fits = F.regexp_like("__base", _glob_pattern(F.col("__glob")))
    return rows, globs.join(listed, ["__dir", "__piece"]).filter(fits), ["__dir", "__glob"]


def _pieces(name: Column, length: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - length + 1, F.lit(1)))
    found = F.transform(starts, lambda i: F.substring(name, i, length))
    return F.when(F.length(name) >= length, found).otherwise(F.array().cast("array<string>"))


def _glob_pattern(glob: Column) -> Column:
    """JVM pattern of a glob segment held in a column; a bracket that nothing closes is a plain character."""

    def part(token: Column) -> Column:
        negated = F.startswith(token, F.lit("[!"))
        body = F.substring(token, F.when(negated, 3).otherwise(2), F.length(token) - F.when(negated, 3).otherwise(2))
        body = F.regexp_replace(body, r"([\[\]\\&^])", r"\\$1")
        klass = F.concat(F.when(negated, "[^").otherwise("["), body, F.lit("]"))
        plain = F.regexp_replace(token, r"([\\.^$|(){}+\[\]])", r"\\$1")
        return F.when(token == "*", "[^/]*").when(token == "?", "[^/]").when(F.length(token) > 2, klass).otherwise(plain)

    tokens = F.regexp_extract_all(glob, F.lit(rf"(?s){GLOB_WILD}|."), F.lit(0))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, part), ""), F.lit(r"\z"))


def _glob_now(rows: DataFrame, node: GlobExists, markers: DataFrame, name: str, path: str) -> DataFrame:
    rows, fitting, keys = _meet_globs(rows, node, markers.select("path").distinct(), path)
    joined = rows.join(fitting.groupBy(*keys).agg(F.count("*").alias("__count")), keys, "left")
    enough = F.coalesce(F.col("__count"), F.lit(0)) >= node.min_matches
    return joined.withColumn(name, enough).drop(*keys, "__count")


def _glob_then(
    rows: DataFrame, node: GlobExists, markers: DataFrame, name: str, path: str, at: str, limit: int
) -> DataFrame:
    """Number of fitting files at the row's time: the sum of appearances and removals up to it."""
    versions = markers.groupBy("path", "ts").agg(F.bool_or(_present(markers)).alias("here"))
    before = previous(versions, ["path"], ["ts"], {"here": "was"}, limit)
    delta = F.col("here").cast("int") - F.coalesce("was", F.lit(False)).cast("int")
    turns = before.select("path", "ts", delta.alias("__delta")).filter(F.col("__delta") != 0)
    columns = rows.columns
    rows, fitting, keys = _meet_globs(rows, node, turns, path)
    key = F.col(keys[0]) if len(keys) == 1 else F.to_json(F.struct(*keys))
    changes = fitting.select(key.alias("__key"), F.col("ts").alias("__at"), F.lit(0).alias("__kind"), "__delta")
    line = _lay_in(rows, keys, at, changes)
    step = F.coalesce("__delta", F.lit(0))
    counted = running_sum(line, ["__key"], ["__at", "__kind"], step, "__count", limit=limit)
    return _take_out(counted, columns, (F.col("__count") >= node.min_matches).alias(name))


def first_seen(rows: DataFrame, keys: list[str], ts: str = "ts", name: str = "first_ts") -> DataFrame:
    """Add the earliest ``ts`` of each key. Aggregated and joined back, so a hot key is no single task's work."""
    first = rows.groupBy(*keys).agg(F.min(ts).alias(name))
    return attach(rows, first, keys)


def apply_latches(
    rows: DataFrame, latches: Mapping[str, tuple[str, Condition]], keys: list[str], order: list[str]
) -> DataFrame:
    """Make results stick from the first pass (or failure) of their key onwards.

    ``latches`` maps a new column to the raw result it follows and the condition whose flags say how. The place of
    the first such row is an aggregate, one for all latches, so no ordered window over a key is needed.
    """
    place = F.struct(*order)
    firsts, results = [], {}
    for out, (raw, condition) in latches.items():
        mark = f"__first_{out}"
        if condition.persistent_pass and condition.persistent_fail:
            firsts.append(F.min_by(raw, place).alias(mark))
            results[out] = F.col(mark)
        elif condition.persistent_pass or condition.persistent_fail:
            sticky = F.col(raw) if condition.persistent_pass else ~F.col(raw)
            firsts.append(F.min(F.when(sticky, place)).alias(mark))
            reached = F.coalesce(place >= F.col(mark), F.lit(False))
            results[out] = reached if condition.persistent_pass else ~reached
        else:
            results[out] = F.col(raw)
    columns = rows.columns
    if firsts:
        rows = attach(rows, rows.groupBy(*keys).agg(*firsts), keys)
    return rows.select(*columns, *[result.alias(out) for out, result in results.items()])


def evaluate(
    rows: DataFrame,
    condition: Condition | None,
    keys: list[str],
    order: list[str],
    markers: DataFrame | None = None,
    variables: Mapping[str, Column] | None = None,
    ts: str = "ts",
    attempts: str | None = None,
    metadata: str | None = None,
    payload: str | None = None,
    markers_at: str | None = None,
) -> DataFrame:
    """Add ``passed`` and ``message`` for one condition; ``keys`` name the state it belongs to.

    ``markers_at`` is the time column for markers that come and go (see ``attach_markers``).
    """
    if condition is None:
        return rows.withColumns({"passed": F.lit(True), "message": F.lit("")})
    columns = rows.columns
    flags: dict[int, Column] = {}
    if uses(condition, _Marker):
        rows, flags = attach_markers(rows, condition, markers, variables or {}, markers_at)
    if uses(condition, Timeout):
        rows = first_seen(rows, keys, ts, "__first_ts")
    scope = Scope(
        ts=F.col(ts) if ts in columns else None,
        first_ts=F.col("__first_ts"),
        attempts=F.col(attempts) if attempts else None,
        metadata=F.col(metadata) if metadata else None,
        payload=F.col(payload) if payload else None,
        variables=variables or {},
        marker=flags,
    )
    passed, message = condition.compile(scope)
    rows = rows.withColumns({"raw": passed, "message": message})
    if not (condition.persistent_pass or condition.persistent_fail):
        return rows.select(*columns, F.col("raw").alias("passed"), "message")
    latched = apply_latches(rows, {"passed": ("raw", condition)}, keys, order)
    return latched.select(*columns, "passed", "message")
