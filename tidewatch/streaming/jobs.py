"""The same job logic on live feeds, with keyed state in the state store.

Matching is stateless and happens before the shuffle, so only triggers reach the keyed operators. Rows wait in the state
store until the watermark has passed their time and are then taken in order, so the result does not depend on how a feed
is cut into micro-batches. A key's state is its small memory and the rows of the last ``late`` stretch of time; rows later
than that are dropped and counted. File sources are limited to a fixed size per micro-batch unless the caller sets another.

A feed that has an end gets a mark there: operators called with ``marks`` also read that folder, and ``drain`` puts a row into it
once the feed is read, whose time takes the watermark to the feed's last row. So all rows come out.

``forget`` seconds after the last row of a key its state is cleared, by a timer in event time (state TTL goes by the clock and
would make results depend on it); what comes later is a new key. A job is forgotten only once it has ended.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.lifecycle import Spec, step
from tidewatch.session import STATE_STORE_PROVIDER, scratch_path
from tidewatch.sources.logs import bounded
from tidewatch.sources.sinks import write_stream

RUNTIME = T.StructType(
    [
        T.StructField("attempts", T.IntegerType()),
        T.StructField("submitted", T.BooleanType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("closed_chunk", T.LongType()),
    ]
)
MEMORY_KEY = T.StructType([T.StructField("action", T.StringType())])
MEMORY = T.StructType(
    [
        T.StructField("started", T.LongType()),
        T.StructField("last", T.LongType()),
        T.StructField("latch", T.BooleanType()),
    ]
)
DECISIONS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("chunk_seq", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("rule_idx", T.IntegerType()),
        T.StructField("match_seq", T.IntegerType()),
        T.StructField("us", T.LongType()),
        T.StructField("evaluated", T.BooleanType()),
        T.StructField("fired", T.BooleanType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("outcome", T.StringType()),
    ]
)

DECISION = Row(*DECISIONS.names)


class _Memories:
    """The rules' remembered state, read and written one rule at a time."""

    def __init__(self, stored) -> None:
        self.stored, self.seen, self.dirty = stored, {}, set()

    def get(self, key: str):
        if key not in self.seen:
            found = self.stored.getValue((key,)) if self.stored.containsKey((key,)) else None
            self.seen[key] = None if found is None else list(found)
        return self.seen[key]

    def __setitem__(self, key: str, value) -> None:
        if self.seen.get(key) != value:
            self.dirty.add(key)
        self.seen[key] = value

    def flush(self) -> None:
        for key in self.dirty:
            self.stored.updateValue((key,), tuple(self.seen[key]))


#: Fixed value: the key of the rows that mark the end of a feed.
END_KEY = "\x00end"
MARKS = T.StructType([T.StructField("key", T.StringType()), T.StructField("us", T.LongType())])
_MICROS = T.StructType([T.StructField("us", T.LongType())])


class OrderedProcessor(StatefulProcessor):
    """Hands a key's rows to ``take`` in order, once the watermark has passed them.

    ``waiting`` is the shape of the rows, with their time as ``us``; ``due`` may name one more time to be called at. With
    ``forget`` (milliseconds), ``clear`` is called so long after the last row taken, unless ``needed`` says otherwise.
    The rows that one micro-batch brings are held as one value, an array per column, so the store is asked per key and not per row.
    """

    waiting: T.StructType
    forget: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = namedtuple("Waiting", self.waiting.names)
        columns = [T.StructField(field.name, T.ArrayType(field.dataType)) for field in self.waiting]
        self.pending = handle.getListState("pending", T.StructType(columns))
        if self.forget is not None:
            self.latest = handle.getValueState("latest", _MICROS)

    def order(self, row: Row) -> tuple:
        raise NotImplementedError

    def take(self, key: Any, ready: list[Row], mark: int) -> Iterator[Row]:
        raise NotImplementedError

    def due(self) -> int | None:
        return None

    def needed(self) -> bool:
        return False

    def clear(self) -> None:
        raise NotImplementedError

    def _taken(self, key: Any, ready: list[Row], mark: int) -> Iterator[Row]:
        """``take``, with the state cleared between rows and after them wherever the key was silent for long enough."""
        if self.forget is None:
            yield from self.take(key, ready, mark)
            return
        latest = self.latest.get()[0] if self.latest.exists() else None
        at = 0
        for i, row in enumerate(ready):
            if latest is not None and row.us - latest > self.forget * 1000:
                yield from self.take(key, ready[at:i], (latest // 1000) + self.forget)
                at = i
                if not self.needed():
                    self.clear()
            latest = row.us if latest is None else max(latest, row.us)
        yield from self.take(key, ready[at:], mark)
        if latest is not None:
            self.latest.update((latest,))
            if self._idle_at() <= mark and not self.needed():
                self.clear()
                self.latest.clear()

    def _idle_at(self) -> int:
        return self.latest.get()[0] // 1000 + self.forget + 1

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if key[0] == END_KEY:
            return
        came = list(rows)
        places = map(came[0].__fields__.index, (*self.waiting.names, "us"))
        *columns, times = map(list, zip(*map(itemgetter(*places), came), strict=True))
        self.pending.appendValue(tuple(columns))
        first = min(times) // 1000
        if first <= timerValues.getCurrentWatermarkInMs():
            yield from self._release(key, timerValues)
        # Rows held from before have a timer of their own, which calls in this micro-batch if they are due.
        elif all(timer > first for timer in self.handle.listTimers()):
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._release(key, timerValues)

    def _release(self, key: Any, timerValues: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [row for columns in self.pending.get() for row in map(self.row, *columns)]
        rest = [row for row in held if row.us // 1000 > mark]
        if len(rest) < len(held):
            self.pending.clear()
            if rest:
                self.pending.appendValue(tuple(map(list, zip(*rest, strict=True))))
        yield from self._taken(key, sorted((row for row in held if row.us // 1000 <= mark), key=self.order), mark)
        wanted = {min(row.us for row in rest) // 1000} if rest else set()
        if (due := self.due()) is not None:
            wanted.add(due)
        if self.forget is not None and self.latest.exists() and not self.needed():
            wanted.add(self._idle_at())
        known = set(self.handle.listTimers())
        for timer in known - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - known:
            self.handle.registerTimer(timer)

    def close(self) -> None:
        pass


class JobProcessor(OrderedProcessor):
    """One job's lifecycle: its runtime as a value, its rules' memories as a map, cleared when the job ends."""

    waiting = T.StructType(
        [
            T.StructField("chunk_seq", T.LongType()),
            T.StructField("kind", T.IntegerType()),
            T.StructField("rule_idx", T.IntegerType()),
            T.StructField("match_seq", T.IntegerType()),
            T.StructField("us", T.LongType()),
            T.StructField("held", T.ArrayType(T.IntegerType())),
            T.StructField("flag", T.BooleanType()),
        ]
    )

    def __init__(self, spec: Spec, forget: int | None = None) -> None:
        self.spec, self.forget = spec, forget

    def needed(self) -> bool:
        return not self.runtime.exists() or self.runtime.get()[2] is None

    def clear(self) -> None:
        self.runtime.clear()
        self.memory.clear()

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        """A job goes on from what ``end_states`` says of it."""
        state = initialState
        self.runtime.update((state.attempts, state.submitted, state.outcome, None))
        for held in state.memory or ():
            self.memory.updateValue((held["gate"],), (held["started"], held["last"], held["latch"]))

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.runtime = handle.getValueState("runtime", RUNTIME)
        self.memory = handle.getMapState("memory", MEMORY_KEY, MEMORY)

    def order(self, row: Row) -> tuple:
        return row.chunk_seq, row.kind, row.rule_idx, row.match_seq

    def take(self, key: Any, ready: list[Row], mark: int) -> Iterator[Row]:
        if not ready:
            return
        state = self.spec.fresh()
        if self.runtime.exists():
            state.update(zip("asoc", self.runtime.get()))
        open_before = state["o"] is None
        memories = state["m"] = _Memories(self.memory)
        for row in ready:
            seen, fired = step(
                self.spec, state, row.chunk_seq, row.kind, row.rule_idx, row.us, row.held, row.flag
            )
            yield DECISION(
                key[0],
                row.chunk_seq,
                row.kind,
                row.rule_idx,
                row.match_seq,
                row.us,
                seen,
                fired,
                state["a"],
                state["o"],
            )
        self.runtime.update((state["a"], state["s"], state["o"], state["c"]))
        if state["o"] is None:
            memories.flush()
        elif open_before:
            self.memory.clear()


def _keyed(rows: DataFrame, key: str, at: str, late: str, marks: str | None = None) -> Any:
    timed = rows.withColumns({key: F.col(key).cast("string"), at: F.col(at).cast("long")})
    if marks is not None:
        ends = rows.sparkSession.readStream.schema(MARKS).parquet(marks)
        timed = timed.unionByName(ends.select(F.col("key").alias(key), F.col("us").alias(at)), allowMissingColumns=True)
    return timed.withColumn("at", F.timestamp_micros(at)).withWatermark("at", late).groupBy(key)


def _millis(seconds: float | None) -> int | None:
    return None if seconds is None else int(seconds * 1000)


def marks_folder(spark: SparkSession, name: str = "marks") -> str:
    """A new folder for the mark at the end of one feed, empty so far."""
    folder = scratch_path(spark, name)
    spark.createDataFrame([], MARKS).write.parquet(folder)
    return folder


def job_decisions(
    rows: DataFrame, spec: Spec, late: str = "1 hour", marks: str | None = None, initial: DataFrame | None = None, forget: float | None = None
) -> DataFrame:
    """Replay rows of a stream (see ``trigger_rows`` and ``poll_rows``) with what came of each, up to the watermark.

    ``initial``, as from ``lifecycle.end_states``, holds where jobs stand before the stream's first row.
    """
    keyed = _keyed(rows, "job_id", "us", late, marks)
    processor = JobProcessor(spec, _millis(forget))
    before = None if initial is None else initial.withColumn("job_id", F.col("job_id").cast("string")).groupBy("job_id")
    return keyed.transformWithState(processor, DECISIONS, "Append", "EventTime", before)


TRANSITIONS = T.StructType(
    [
        T.StructField("runtime_job_id", T.StringType()),
        T.StructField("us", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("old_status", T.StringType()),
        T.StructField("new_status", T.StringType()),
        T.StructField("transition", T.StringType()),
    ]
)
TRANSITION = Row(*TRANSITIONS.names)


class TransitionProcessor(OrderedProcessor):
    """Last status of a key, to tell a change from a repetition."""

    waiting = T.StructType(
        [
            T.StructField("us", T.LongType()),
            T.StructField("seq", T.LongType()),
            T.StructField("status", T.StringType()),
        ]
    )

    def __init__(self, forget: int | None = None) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", T.StructType([T.StructField("status", T.StringType())]))

    def clear(self) -> None:
        self.last.clear()

    def order(self, row: Row) -> tuple:
        return row.us, row.seq

    def take(self, key: Any, ready: list[Row], mark: int) -> Iterator[Row]:
        old = self.last.get()[0] if self.last.exists() else None
        for row in ready:
            if row.status != old:
                yield TRANSITION(key[0], row.us, row.seq, old, row.status, f"{old} -> {row.status}")
            old = row.status
        if ready:
            self.last.update((old,))


def stream_transitions(
    snapshots: DataFrame, late: str = "1 hour", marks: str | None = None, forget: float | None = None
) -> DataFrame:
    """Status changes of a stream of ``(runtime_job_id, us, seq, status)``, up to the watermark."""
    keyed = _keyed(snapshots, "runtime_job_id", "us", late, marks)
    return keyed.transformWithState(TransitionProcessor(_millis(forget)), TRANSITIONS, "Append", "EventTime")


SILENCE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("since_us", T.LongType()),
        T.StructField("until_us", T.LongType()),
    ]
)
SILENT = Row(*SILENCE.names)
OPEN = T.StructType([T.StructField("us", T.LongType()), T.StructField("told", T.BooleanType())])


class TimeoutProcessor(StatefulProcessor):
    """Reports a key once ``timeout_seconds`` have passed since its first row, input or not."""

    def __init__(self, timeout_seconds: float) -> None:
        self.millis = int(timeout_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", _MICROS)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if key[0] == END_KEY:
            return iter(())
        first = min(row.us for row in rows)
        known = self.started.get()[0] if self.started.exists() else None
        # An earlier row may come in a later micro-batch, as long as the watermark has not passed it.
        if known is None or first < known:
            if known is not None:
                self.handle.deleteTimer(known // 1000 + self.millis)
            self.started.update((first,))
            self.handle.registerTimer(first // 1000 + self.millis)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        since = self.started.get()[0]
        yield SILENT(key[0], since, since + self.millis * 1000)

    def close(self) -> None:
        pass


class ForgettingTimeoutProcessor(OrderedProcessor):
    """The same, but a key is forgotten ``rest`` milliseconds after its report and begins anew with a later row."""

    waiting = _MICROS

    def __init__(self, timeout_seconds: float, rest: int) -> None:
        self.millis, self.rest = int(timeout_seconds * 1000), rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.started = handle.getValueState("started", OPEN)

    def order(self, row: Row) -> tuple:
        return (row.us,)

    def take(self, key: Any, ready: list[Row], mark: int) -> Iterator[Row]:
        since, told = self.started.get() if self.started.exists() else (None, False)
        for row in ready:
            if since is not None and row.us // 1000 > self._up(since) + self.rest:
                if not told:
                    yield SILENT(key[0], since, since + self.millis * 1000)
                since, told = None, False
            since = row.us if since is None else since
        if since is not None and not told and self._up(since) <= mark:
            yield SILENT(key[0], since, since + self.millis * 1000)
            told = True
        if since is None or told and self._up(since) + self.rest < mark:
            self.started.clear()
        else:
            self.started.update((since, told))

    def due(self) -> int | None:
        since, told = self.started.get() if self.started.exists() else (None, False)
        return None if since is None else self._up(since) + (self.rest + 1 if told else 0)

    def _up(self, since: int) -> int:
        return since // 1000 + self.millis


class InactivityProcessor(OrderedProcessor):
    """Reports each silence of more than ``gap_seconds``: when the next row ends it, or when its time is up."""

    waiting = _MICROS

    def __init__(self, gap_seconds: float, forget: int | None = None) -> None:
        self.micros, self.forget = int(gap_seconds * 1_000_000), forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", OPEN)

    def needed(self) -> bool:
        return self.last.exists() and not self.last.get()[1]

    def clear(self) -> None:
        self.last.clear()

    def order(self, row: Row) -> tuple:
        return (row.us,)

    def take(self, key: Any, ready: list[Row], mark: int) -> Iterator[Row]:
        last, told = self.last.get() if self.last.exists() else (None, False)
        for row in ready:
            if last is not None and row.us - last > self.micros:
                yield SILENT(key[0], last, row.us)
            last, told = row.us, False
        if last is not None and not told and self._time_up(last) <= mark:
            yield SILENT(key[0], last, None)
            told = True
        if last is not None:
            self.last.update((last, told))

    def due(self) -> int | None:
        last, told = self.last.get() if self.last.exists() else (None, True)
        return None if told else self._time_up(last)

    def _time_up(self, last: int) -> int:
        return (last + self.micros) // 1000 + 1


def _timed(rows: DataFrame, key: str, ts: str, late: str, marks: str | None) -> Any:
    shaped = rows.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return _keyed(shaped, "key", "us", late, marks)


def stream_timeouts(
    rows: DataFrame, key: str, timeout_seconds: float, ts: str = "ts", late: str = "1 hour", marks: str | None = None, forget: float | None = None
) -> DataFrame:
    """Keys whose timeout passed, by event time. Rows later than ``late`` are dropped."""
    processor = TimeoutProcessor(timeout_seconds) if forget is None else ForgettingTimeoutProcessor(timeout_seconds, _millis(forget))
    return _timed(rows, key, ts, late, marks).transformWithState(processor, SILENCE, "Append", "EventTime")


def stream_inactivity(
    rows: DataFrame, key: str, gap_seconds: float, ts: str = "ts", late: str = "1 hour", marks: str | None = None, forget: float | None = None
) -> DataFrame:
    """Silences of a stream; one still open when its time is up has no end."""
    processor = InactivityProcessor(gap_seconds, _millis(forget))
    return _timed(rows, key, ts, late, marks).transformWithState(processor, SILENCE, "Append", "EventTime")


def read_stream(spark: SparkSession, table: str, **options: str) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream with the schema it has now."""
    schema = spark.read.parquet(table).schema
    # A stream takes a plain path for a folder only; as a pattern it may be a file as well.
    pattern = f"{table[:-1]}[{table[-1]}]"
    return spark.readStream.schema(schema).options(**bounded(options)).parquet(pattern)


def drain(
    spark: SparkSession,
    stream: DataFrame,
    name: str,
    path: str | None = None,
    checkpoint: str | None = None,
    marks: str | None = None,
    late: str = "1 hour",
    every: str | None = None,
) -> DataFrame:
    """Run a stream over all that is there and read back what it wrote; ``every`` polls at that interval instead of at once.

    Pass the same path and checkpoint again to go on where the last run stopped. ``marks`` is the folder the stream was made
    with and says that the feed ends here: rows held back up to ``late`` come out too, and later ones would be dropped.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE_PROVIDER)
    path = path or scratch_path(spark, name)
    checkpoint = checkpoint or f"{path}-checkpoint"
    progress = _run(stream, path, checkpoint, every)
    if marks is not None and (end := _last_time(spark, progress, late)) is not None:
        spark.createDataFrame([(END_KEY, end)], MARKS).coalesce(1).write.mode("append").parquet(marks)
        _run(stream, path, checkpoint, every)
    return spark.read.schema(stream.schema).parquet(path)


def _run(stream: DataFrame, path: str, checkpoint: str, every: str | None) -> list[dict]:
    query = write_stream(stream, path, checkpoint, every is None, every or "")
    if every is None:
        query.awaitTermination()
    else:
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    if query.exception() is not None:
        raise query.exception()
    return [json.loads(p.json) for p in query.recentProgress]


def _last_time(spark: SparkSession, progress: list[dict], late: str) -> int | None:
    """Time of a row that takes the watermark to the last row of a feed; None for a feed without rows."""
    seen = [(p.get("eventTime", {}).get("max"), F.expr("interval 0 seconds")) for p in progress]
    seen += [(p.get("eventTime", {}).get("watermark"), F.expr(f"interval {late}")) for p in progress]
    times = [F.to_timestamp(F.lit(at)) + after + F.expr(f"interval {late}") for at, after in seen if at and not at.startswith("1970-01-01T00:00:00")]
    if not times:
        return None
    return spark.range(1).select(F.array_max(F.transform(F.array(*times), F.unix_micros))).first()[0]


def late_rows(progress: list[dict]) -> int:
    """Rows dropped as too late, from a query's progress reports."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p.get("stateOperators", []))
