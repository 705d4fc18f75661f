"""Growing log files by byte ranges: only what lies behind the cursor is read, and a large increment by several tasks.

An increment is cut into ranges of bytes. A line belongs to the range in which its first byte lies, so a range begins
behind the first line end at or before its first byte and goes on to the end of its last line. Text is decoded as UTF-8; a
character that the cursor or the end of the file cuts reads as the replacement character. Cursors count bytes.

Two forms: tables of logs and cursors in batch, and a data source (``log_tail``) for batch and streams, which keeps each file's
place in the stream's checkpoint. Files are opened where they are read, by their path or URI.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewatch.session import materialise

#: Bytes of a range; one range is one task's text.
RANGE_BYTES = 32 << 20
#: Bytes looked through at once for the next line end.
BLOCK = 1 << 20
#: Reading tasks at most; with more ranges each task reads several.
MOST_TASKS = 20_000


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def size_of(path: str | None) -> int:
    """Bytes of a file now; a missing one has none."""
    if not path:
        return 0
    store, name = _open(path)
    return store.get_file_info(name).size or 0


def ranges_of(start: int, end: int, step: int) -> list[tuple[int, int]]:
    return [(at, min(at + step, end)) for at in range(start, end, step)]


def _line_start(source, at: int, size: int) -> int:
    """First place from ``at`` on that stands behind a line end, or the size."""
    at -= 1
    source.seek(at)
    while at < size:
        block = source.read(min(BLOCK, size - at))
        if not block:
            break
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return size


def read_range(path: str, first: int, start: int, end: int, size: int) -> tuple[int, str]:
    """Where the lines of a range begin, and their text. ``first`` and ``size`` are where the whole increment begins and ends."""
    store, name = _open(path)
    with store.open_input_file(name) as source:
        begin = start if start == first else _line_start(source, start, size)
        if begin >= end:
            return begin, ""
        stop = size if end >= size else _line_start(source, end, size)
        source.seek(begin)
        return begin, source.read(stop - begin).decode("utf-8", "replace")


def _sized(logs: DataFrame, cursors: DataFrame) -> DataFrame:
    """job_id, path, first (where new text begins), size; a log shorter than its cursor has no new text."""
    kind = logs.schema["job_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([size_of(p) for p in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes], ["job_id", "path", "first", "size"])

    at = F.greatest(F.coalesce(F.col("log_cursor").cast("bigint"), F.lit(0)), F.lit(0))
    joined = logs.select("job_id", "path").join(cursors.select("job_id", "log_cursor"), "job_id", "left")
    return joined.select("job_id", "path", at.alias("first")).mapInArrow(run, f"job_id {kind}, path string, first bigint, size bigint")


def next_cursors(logs: DataFrame, cursors: DataFrame) -> DataFrame:
    """(job_id, log_cursor) after reading ``logs`` (job_id, path) from ``cursors`` (job_id, log_cursor); it never goes back."""
    return _sized(logs, cursors).select("job_id", F.greatest("first", "size").alias("log_cursor"))


def new_text(logs: DataFrame, cursors: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """New text of ``logs`` (job_id, path) behind ``cursors`` (job_id, log_cursor): job_id, path, start, text, log_cursor.

    One row per range that holds text, ``start`` in bytes; rows of a job put together in that order are its whole new text.
    ``log_cursor`` is the job's next one, also to be had from ``next_cursors`` for jobs without new text. A job without a
    cursor is read from its beginning; a null path or missing file has no text. The ranges are written to the shared folder, so
    the sizes are looked up once and a file that grows meanwhile is read up to where it ended then.
    """
    kind = logs.schema["job_id"].dataType.simpleString()
    sized = _sized(logs, cursors).filter("size > first")
    cut = F.explode(F.sequence("first", F.col("size") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = sized.withColumn("start", cut).withColumn("end", F.least(F.col("start") + range_bytes, "size"))
    ranges = materialise(ranges, "log-ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["job_id", "path", "start", "text", "log_cursor"]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                path, first, size, start, end = (row.column(j)[0].as_py() for j in range(1, 6))
                begin, text = read_range(path, first, start, end, size)
                if text:
                    yield pa.RecordBatch.from_arrays(
                        [row.column(0), row.column(1), pa.array([begin], pa.int64()), pa.array([text]), row.column(3)], names
                    )

    # With the number given, the few narrow rows aren't put into one partition.
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    return ranges.repartition(tasks).mapInArrow(run, f"job_id {kind}, path string, start bigint, text string, log_cursor bigint")


class Range(InputPartition):
    def __init__(self, path: str, first: int, start: int, end: int, size: int):
        self.at = (path, first, start, end, size)


def _read(partition: Range) -> Iterator[tuple]:
    begin, text = read_range(*partition.at)
    if text:
        yield partition.at[0], begin, text


class _Files:
    """Which files there are, and the ranges between two places in each."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix = options["path"], options.get("suffix", "")
        self.step = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def sizes(self) -> dict[str, int]:
        store, name = _open(self.folder)
        scheme = self.folder[: self.folder.index("://") + 3] if "://" in self.folder else ""
        found = store.get_file_info(pafs.FileSelector(name, recursive=True, allow_not_found=True))
        return {scheme + f.path: f.size for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix)}

    def between(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        cuts = [(path, start.get(path, 0), size) for path, size in sorted(end.items())]
        return [Range(path, first, a, b, size) for path, first, size in cuts for a, b in ranges_of(first, size, self.step)]


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files, self.cursors = _Files(options), json.loads(options.get("cursors", "{}"))

    def partitions(self) -> list[Range]:
        return self.files.between(self.cursors, self.files.sizes())

    def read(self, partition: Range) -> Iterator[tuple]:
        return _read(partition)


class _StreamReader(DataSourceStreamReader):
    """The offset is the size of every file seen; a file that shrinks keeps its place."""

    def __init__(self, options: dict[str, str]):
        self.files, self.known = _Files(options), {}

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        now = self.files.sizes()
        self.known = {path: max(size, self.known.get(path, 0)) for path, size in (self.known | now).items()}
        return self.known

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        self.known = {path: max(size, self.known.get(path, 0)) for path, size in end.items()}
        return self.files.between(start, end)

    def read(self, partition: Range) -> Iterator[tuple]:
        return _read(partition)


class LogTail(DataSource):
    """``log_tail``: the files below a folder as (path, start, text), new bytes only.

    Options: ``path`` (folder), ``suffix`` of file names, ``rangeBytes``, and in batch ``cursors`` (JSON of path to bytes). A stream
    keeps one number per file in its checkpoint, which the driver lists, so this form is for as many files as a driver can
    hold; ``new_text`` takes tables of any size.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, start bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("log_tail")`` and ``spark.readStream.format("log_tail")`` known to a session."""
    spark.dataSource.register(LogTail)
