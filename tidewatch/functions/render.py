"""Scalar expressions: templates, scopes, paths and identifiers."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The placeholder syntax templates use.
PLACEHOLDER = re.compile(r"(?<!\$)\{([^\{\}\$:]+)\}")
PLACEHOLDER_JVM = r"(?<!\$)\{([^{}$:]+)\}"


def parse_template(template: str) -> list[tuple[str, str]]:
    """Cut a constant template into ``("text", s)`` and ``("key", name)`` parts."""
    parts: list[tuple[str, str]] = []
    pos = 0
    for hit in PLACEHOLDER.finditer(template):
        if hit.start() > pos:
            parts.append(("text", template[pos : hit.start()]))
        parts.append(("key", hit.group(1)))
        pos = hit.end()
    if pos < len(template):
        parts.append(("text", template[pos:]))
    return parts


def render(template: str, scope: Mapping[str, Column] | Column) -> Column:
    """Render a constant template; a key the scope lacks stays as written, a null value reads ``None``.

    The scope maps names to columns, or is a map column whose keys may differ by row.
    """
    if isinstance(scope, Column):
        return render_from_map(template, scope)
    pieces = []
    for kind, text in parse_template(template):
        if kind == "key" and text in scope:
            pieces.append(F.coalesce(scope[text].cast("string"), F.lit("None")))
        else:
            pieces.append(F.lit(text if kind == "text" else "{" + text + "}"))
    return F.concat(*pieces) if pieces else F.lit("")


def render_from_map(template: str, variables: Column) -> Column:
    """Render a constant template from a map column whose keys may differ by row."""
    pieces = []
    for kind, text in parse_template(template):
        if kind == "text":
            pieces.append(F.lit(text))
        else:
            value = F.coalesce(F.element_at(variables, text), F.lit("None"))
            pieces.append(F.when(F.map_contains_key(variables, text), value).otherwise("{" + text + "}"))
    return F.concat(*pieces) if pieces else F.lit("")


def render_column(template: Column, variables: Column) -> Column:
    """Render a template that is itself a column. Inserted values are never expanded again."""
    tokens = F.regexp_extract_all(template, F.lit(PLACEHOLDER_JVM), F.lit(0))
    keys = F.regexp_extract_all(template, F.lit(PLACEHOLDER_JVM), F.lit(1))
    between = F.split(template, PLACEHOLDER_JVM, -1)
    values = F.zip_with(
        tokens,
        keys,
        lambda token, key: F.when(
            F.map_contains_key(variables, key), F.coalesce(F.element_at(variables, key), F.lit("None"))
        ).otherwise(token),
    )
    joined = F.zip_with(
        between, values, lambda text, value: F.concat(text, F.coalesce(value, F.lit("")))
    )
    return F.array_join(joined, "")


def scoped(key: str, *maps: Column) -> Column:
    """Value of ``key`` from the first map that holds it; list maps from strongest to weakest."""
    chain = None
    for source in maps:
        holds = F.coalesce(F.map_contains_key(source, key), F.lit(False))
        value = F.element_at(source, key)
        chain = F.when(holds, value) if chain is None else chain.when(holds, value)
    return chain


def merge_maps(*maps: Column) -> Column:
    """One map out of several; list them from weakest to strongest."""

    def lay_over(weaker: Column, stronger: Column) -> Column:
        return F.map_concat(F.map_filter(weaker, lambda k, _: ~F.map_contains_key(stronger, k)), stronger)

    return reduce(lay_over, maps)


def event_variables(
    job_metadata: Column,
    event_metadata: Column,
    payload: Column,
    event_id: Column,
    event_name: Column,
    attempts: Column | None = None,
    workspace: Column | None = None,
) -> Column:
    """Variables visible to a template. Actions also see attempts and workspace; conditions do not."""
    fallback = [F.lit("event_id"), event_id, F.lit("event_name"), event_name]
    if attempts is not None:
        fallback += [F.lit("attempts"), attempts.cast("string")]
    if workspace is not None:
        fallback += [F.lit("workspace"), workspace]
    return merge_maps(F.create_map(*fallback), job_metadata, event_metadata, payload)


def with_job_defaults(metadata: Column, job_id: Column, name: Column, class_name: Column) -> Column:
    """Job metadata; the user's own entries win over job_id, job_name and job_class."""
    defaults = F.create_map(
        F.lit("job_id"), job_id.cast("string"), F.lit("job_name"), name, F.lit("job_class"), class_name
    )
    return merge_maps(defaults, metadata)


def expand_log_path(path: Column, job_id: Column, timestamp: Column | None = None) -> Column:
    """Fill ``%A``, ``%a``, ``%j`` and ``%t``; array ids are cut at their first underscore."""
    halves = F.split(job_id, "_", 2)
    out = F.replace(path, F.lit("%A"), halves[0])
    out = F.replace(out, F.lit("%a"), F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("0")))
    out = F.replace(out, F.lit("%j"), job_id)
    if timestamp is not None:
        filled = F.replace(out, F.lit("%t"), timestamp.cast("long").cast("string"))
        out = F.when(timestamp.isNull(), out).otherwise(filled)
    return out


def effective_log_path(
    log_path: Column, log_path_current: Column, job_id: Column, runtime_job_id: Column, start_seconds: Column
) -> Column:
    """Where a job logs now. An id with a non-numeric array suffix gives NULL."""
    has_runtime = runtime_job_id.isNotNull() & (runtime_job_id != "")
    used_id = F.when(has_runtime, runtime_job_id).otherwise(job_id)
    index = F.when(
        F.contains(used_id, F.lit("_")), F.substring_index(used_id, "_", -1).try_cast("int")
    ).otherwise(F.lit(0))
    current = F.replace(log_path_current, F.lit("%a"), index.cast("string"))
    expanded = F.when(index.isNotNull(), expand_log_path(log_path, used_id, start_seconds))
    return F.when(log_path_current.isNotNull() & (log_path_current != ""), current).otherwise(expanded)


def event_id(job_id: Column, event_name: Column, ts: Column, checkpoint_iteration: Column | None = None) -> Column:
    """``job:event[:checkpoint_iteration]:milliseconds``."""
    millis = F.unix_millis(ts.cast("timestamp")).cast("string")
    middle = [] if checkpoint_iteration is None else [checkpoint_iteration.cast("string")]
    return F.concat_ws(":", job_id.cast("string"), event_name, *middle, millis)


def event_key(metadata_json: Column) -> Column:
    """First 16 hex digits of the digest of the metadata's JSON text."""
    return F.substring(F.md5(metadata_json), 1, 16)


def stable_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def action_id(source: Column, name: Column, rule_idx: Column) -> Column:
    """``log:name:idx`` or ``state:name:idx``: the key of a rule's remembered state."""
    return F.concat_ws(":", source, name, rule_idx.cast("string"))


def status_from_return_code(has_process: Column, code: Column, stored: Column) -> Column:
    """Status of a job from its process's return code; without a process the stored state stands."""
    return (
        F.when(~has_process, stored)
        .when(code.isNull(), F.lit("RUNNING"))
        .when(code == 0, F.lit("COMPLETED"))
        .otherwise(F.lit("FAILED"))
    )
