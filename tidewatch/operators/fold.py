"""An ordered, stateful pass over the rows of each key, with no key tied to one task.

The rows are range-partitioned and sorted on (key, order), which splits a hot key over as many partitions as it
needs, and kept with ``checkpoint()`` so that partitions stay the same from pass to pass. Only a key that runs over a
partition border has state to hand on, so one small entry per partition describes everything:

1. each partition is folded on its own and reports the state of its last key at its end;
2. where a partition lies wholly inside one key, its entry state is the end of the partition before it. A guess that
   turns out wrong is folded again. States that behave alike count as equal (``Kernel.reduce``), which makes most
   guesses right; when they keep failing, only the partition whose entry is certain is folded;
3. the last pass folds every partition from its proven entry state and gives the output rows.

A kernel that can describe a partition as a function from entry to exit state (``Kernel.transfer``) needs no guesses in 2.:
the functions are written, composed in groups of consecutive partitions, and evaluated along the groups and then inside
them. That takes the same few jobs however many partitions a key runs over and whatever its rows are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.session import materialise, shared_dir

# Rounds in which every open partition is guessed at, before folding only the certain one.
GUESS_ROUNDS = 6


class Kernel:
    """How one key's rows are folded. States are JSON-ready values; ``None`` is the state before any row.

    ``needs`` names the columns ``run`` and ``reduce`` read; no others are turned into Python values.
    """

    outputs: T.StructType
    needs: tuple[str, ...] = ()

    def run(self, state: Any, cols: dict[str, Any], lo: int, hi: int, out: dict[str, list] | None) -> Any:
        """Fold rows ``lo`` to ``hi`` of one key; append to ``out`` unless it is None; return the new state."""
        raise NotImplementedError

    def reduce(self, state: Any, first: dict[str, Any]) -> tuple[Any, Any]:
        """Split a state into the part that can change what follows and a remainder.

        ``first`` is the row the state meets next. ``restore`` puts the remainder back.
        """
        return state, None

    def restore(self, state: Any, rest: Any) -> Any:
        return state

    def guess(self, entry: Any, other: Any, end: Any) -> Any:
        """Where ``entry`` may lead, given that the same rows led from state ``other`` to ``end``."""
        return end

    #: ``transfer`` gives the function of a run of rows of one key; states are then whole numbers or None.
    transfer: Callable[[dict[str, np.ndarray]], Steps] | None = None


@dataclass(frozen=True)
class Steps:
    """A function of an entry state: up to ``breaks[i]`` (ascending) it is ``exits[i]``; above all breaks it is the entry itself.

    The state before any row, None, is below all breaks.
    """

    breaks: np.ndarray
    exits: np.ndarray

    def __call__(self, entries: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.breaks, entries)
        inside = at < len(self.breaks)
        return np.where(inside, self.exits[np.where(inside, at, 0)] if len(self.exits) else entries, entries)

    def then(self, after: Steps) -> Steps:
        """This function, then ``after``. Equal neighbours become one, so what rows forget costs nothing further on."""
        beyond = after.breaks > self.breaks[-1] if len(self.breaks) else np.ones(len(after.breaks), bool)
        breaks = np.concatenate([self.breaks, after.breaks[beyond]])
        return Steps(breaks, np.concatenate([after(self.exits), after.exits[beyond]])).merged()

    def merged(self) -> Steps:
        last = np.append(self.exits[1:] != self.exits[:-1], True)[: len(self.exits)]
        return Steps(self.breaks[last], self.exits[last])


def _columns(batch: pa.RecordBatch, kernel: Kernel, numeric: set[str]) -> dict[str, Any]:
    found = {name: batch.column(batch.schema.get_field_index(name)) for name in ("__key", "__pid", *kernel.needs)}
    return {
        name: (col.to_numpy(zero_copy_only=False) if name in numeric else col.to_pylist())
        for name, col in found.items()
    }


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i
            start = i


def _numeric(schema: T.StructType) -> set[str]:
    return {f.name for f in schema if isinstance(f.dataType, (T.LongType, T.IntegerType)) and not f.nullable}


def _summarise(kernel: Kernel, numeric: set[str], entries: dict[int, Any]):
    """Report per partition: first and last key, the first row, and the state of the last key at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = first_key = first_row = last_key = state = None
        single = True
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = _columns(batch, kernel, numeric)
            keys, n = cols["__key"], batch.num_rows
            if pid is None:
                pid, first_key = int(cols["__pid"][0]), keys[0]
                first_row = {k: (v[0].item() if hasattr(v[0], "item") else v[0]) for k, v in cols.items()}
                last_key, state = first_key, entries.get(pid)
            lo = 0
            if keys[-1] != last_key:
                # Only the last key's end state is reported, so keys that end inside the batch are passed over.
                single, last_key, state = False, keys[-1], None
                lo = n - 1
                while lo and keys[lo - 1] == last_key:
                    lo -= 1
            state = kernel.run(state, cols, lo, n, None)
        if pid is not None:
            report = {"first": first_key, "last": last_key, "single": single, "row": first_row, "exit": state}
            yield pa.RecordBatch.from_pydict(
                {"pid": pa.array([pid], pa.int32()), "report": [json.dumps(report, default=str)]}
            )

    return run


def _emit(kernel: Kernel, numeric: set[str], entries: dict[int, Any], keep: list[str]):
    types = {field.name: to_arrow_type(field.dataType) for field in kernel.outputs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        started = False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = _columns(batch, kernel, numeric)
            if not started:
                started, key, state = True, cols["__key"][0], entries.get(int(cols["__pid"][0]))
            out: dict[str, list] = {name: [] for name in types}
            for lo, hi in _runs(cols["__key"]):
                if cols["__key"][lo] != key:
                    key, state = cols["__key"][lo], None
                state = kernel.run(state, cols, lo, hi, out)
            kept = [batch.column(batch.schema.get_field_index(name)) for name in keep]
            made = [pa.array(out[name], kind) for name, kind in types.items()]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *types])

    return run


def _resolve(kernel: Kernel, parts: list[int], reports: dict[int, dict], fold) -> dict[int, Any]:
    """Entry state of every partition that starts in the middle of a key."""
    entries: dict[int, Any] = {}
    known: dict[int, dict[str, Any]] = {}

    def token(pid: int, state: Any) -> tuple[str, Any, Any]:
        core, rest = kernel.reduce(state, reports[pid]["row"])
        return json.dumps(core, sort_keys=True), core, rest

    latest: dict[int, tuple[Any, Any]] = {}
    for pid in parts:
        if reports[pid]["single"]:
            known[pid] = {json.dumps(None): reports[pid]["exit"]}
            latest[pid] = (None, reports[pid]["exit"])
    for round_no in range(len(parts) + 1):
        ask: dict[int, Any] = {}
        certain, carry = True, None
        for at, pid in enumerate(parts):
            report = reports[pid]
            if not at or reports[parts[at - 1]]["last"] != report["first"]:
                # The key starts here, so the first fold of this partition already had the right entry.
                certain, carry = True, report["exit"]
                continue
            if certain:
                entries[pid] = carry
            if not report["single"]:
                certain, carry = True, report["exit"]
                continue
            name, core, rest = token(pid, carry)
            if name in known[pid]:
                carry = kernel.restore(known[pid][name], rest)
                continue
            if certain or round_no < GUESS_ROUNDS:
                ask[pid] = core
            carry, certain = kernel.guess(carry, *latest[pid]), False
        if not ask:
            return entries
        for pid, exit_state in fold(ask).items():
            known[pid][json.dumps(ask[pid], sort_keys=True)] = exit_state
            latest[pid] = (ask[pid], exit_state)
    return entries


#: Fixed value that stands for the state None in a function.
_NONE = -(2**63)
_FUNCTIONS = "chain int, part int, pid int, breaks binary, exits binary"


def _state(number: int) -> int | None:
    return None if number == _NONE else number


def _functions(kernel: Kernel, places: dict[int, tuple[int, int]]):
    """The function of each partition that lies inside a key, from all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, columns = None, {name: [] for name in kernel.needs}
        for batch in batches:
            if batch.num_rows and (pid := batch.column(0)[0].as_py()) in places:
                for i, name in enumerate(kernel.needs):
                    columns[name].append(batch.column(i + 1).to_numpy(zero_copy_only=False))
        if pid in places:
            found = kernel.transfer({name: np.concatenate(parts) for name, parts in columns.items()}).merged()
            yield _function_row(*places[pid], pid, found)

    return run


def _function_row(chain: int, part: int, pid: int, steps: Steps) -> pa.RecordBatch:
    numbers = {k: pa.array([v], pa.int32()) for k, v in (("chain", chain), ("part", part), ("pid", pid))}
    arrays = {k: pa.array([v.astype("<i8").tobytes()], pa.binary()) for k, v in (("breaks", steps.breaks), ("exits", steps.exits))}
    return pa.RecordBatch.from_pydict(numbers | arrays)


def _read_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, Steps]]:
    for batch in batches:
        for i in range(batch.num_rows):
            chain, part, pid, breaks, exits = (batch.column(j)[i].as_py() for j in range(5))
            yield chain, part, pid, Steps(np.frombuffer(breaks, "<i8"), np.frombuffer(exits, "<i8"))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One function per (chain, part), of its partitions in order."""
    for (chain, part), rows in groupby(_read_functions(batches), key=lambda r: r[:2]):
        yield _function_row(chain, part, -1, reduce(Steps.then, (steps for *_, steps in rows)))


def _walk(entries: dict[Any, int], by: int):
    """Entry and exit of every function along the groups named by the first ``by`` numbers of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in groupby(_read_functions(batches), key=lambda r: r[:by]):
            state = np.array([entries[group]], np.int64)
            for chain, part, pid, steps in rows:
                after = steps(state)
                numbers = {k: pa.array([v], pa.int32()) for k, v in (("chain", chain), ("part", part), ("pid", pid))}
                yield pa.RecordBatch.from_pydict(numbers | {"entry": pa.array(state), "exit": pa.array(after)})
                state = after

    return run


def _evaluated(kernel: Kernel, frame: DataFrame, parts: list[int], reports: dict[int, dict]) -> dict[int, Any]:
    """Entry states by composed functions; the same jobs however long a key's run of partitions is."""
    follows = {pid for before, pid in zip(parts, parts[1:]) if reports[before]["last"] == reports[pid]["first"]}
    chains: list[list[int]] = []
    for before, pid in zip([None, *parts], parts):
        if pid in follows and reports[pid]["single"]:
            if chains and chains[-1][-1] == before:
                chains[-1].append(pid)
            else:
                chains.append([pid])
    exits = {pid: report["exit"] for pid, report in reports.items()}
    entries: dict[int, Any] = {}
    if chains:
        previous = dict(zip(parts[1:], parts))
        places = {}
        for number, chain in enumerate(chains):
            size = math.isqrt(len(chain) - 1) + 1
            places |= {pid: (number, i // size) for i, pid in enumerate(chain)}
        first = {(number,): exits[previous[chain[0]]] for number, chain in enumerate(chains)}
        first = {k: _NONE if v is None else v for k, v in first.items()}
        functions = materialise(frame.select("__pid", *kernel.needs).mapInArrow(_functions(kernel, places), _FUNCTIONS), "functions")
        dealt = functions.repartition("chain", "part").sortWithinPartitions("chain", "part", "pid")
        whole = dealt.mapInArrow(_compose, _FUNCTIONS).repartition("chain").sortWithinPartitions("chain", "part")
        shape = "chain int, part int, pid int, entry bigint, exit bigint"
        starts = {(r.chain, r.part): r.entry for r in whole.mapInArrow(_walk(first, 1), shape).collect()}
        for r in dealt.mapInArrow(_walk(starts, 2), shape).collect():
            entries[r.pid], exits[r.pid] = _state(r.entry), _state(r.exit)
    for before, pid in zip(parts, parts[1:]):
        if pid in follows:
            entries[pid] = exits[before]
    return entries


def ordered_fold(
    rows: DataFrame, key: str, order: Sequence[str], kernel: Kernel, partitions: int | None = None
) -> DataFrame:
    """``rows`` with the kernel's output columns. (key, order) must name each row uniquely.

    Runs Spark jobs when called: the sort, one narrow pass, and repeats for keys larger than a partition.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = (
        rows.withColumn("__key", F.col(key).cast("string"))
        .repartitionByRange(count, "__key", *order)
        .sortWithinPartitions("__key", *order)
        .checkpoint()
        .withColumn("__pid", F.spark_partition_id())
    )
    numeric = _numeric(sorted_rows.schema)

    def reports_for(frame: DataFrame, entries: dict[int, Any]) -> dict[int, dict]:
        narrow = frame.select("__key", "__pid", *kernel.needs)
        found = narrow.mapInArrow(_summarise(kernel, numeric, entries), "pid int, report string").collect()
        return {r.pid: json.loads(r.report) for r in found}

    schema = T.StructType([*rows.schema.fields, *kernel.outputs.fields])
    reports = reports_for(sorted_rows, {})
    parts = sorted(reports)
    if kernel.transfer is not None:
        entries = _evaluated(kernel, sorted_rows, parts, reports)
        return sorted_rows.mapInArrow(_emit(kernel, numeric, entries, rows.columns), schema)

    def fold_again(asked: dict[int, Any]) -> dict[int, Any]:
        some = sorted_rows.filter(F.col("__pid").isin(list(asked)))
        return {pid: report["exit"] for pid, report in reports_for(some, asked).items()}

    entries = _resolve(kernel, parts, reports, fold_again)
    return sorted_rows.mapInArrow(_emit(kernel, numeric, entries, rows.columns), schema)
