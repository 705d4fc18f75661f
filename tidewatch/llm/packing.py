"""Best-fit packing planned over a histogram of piece lengths.

Only how many pieces have each length matters for the plan, so best fit runs over at most ``window`` counts, whatever the
number of documents. The plan says where the first, second, ... piece of each length goes; pieces take these places by
their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import BUCKET_ROWS, bucket_count, numbered
from tidewatch.llm.tokens import encoder, map_texts
from tidewatch.session import materialise

#: Tokens of a sequence.
WINDOW = 2048
#: Plan rows that may be broadcast; a larger plan is joined by a shuffle.
BROADCAST_PLAN_ROWS = 200_000

#: Documents of a stretch that is packed by itself where an order is kept.
STRETCH_ROWS = 2_000

PLAN = "length bigint, rank_from bigint, rank_to bigint, sequence_from bigint, at bigint, each bigint"


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = WINDOW,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    special: bool = False,
    digest: bool = False,
) -> DataFrame:
    """Encode whole texts, end each with ``end_id`` and cut those longer than ``window``.

    One row per piece: ``keep``, ``piece`` from 0, ``start``, ``length`` and ``ids`` (little-endian unsigned 32-bit), or with
    ``digest`` only their ``ids_crc32``, so that no ids leave the Python worker. A null or empty text has one piece, the end id. No
    documents, no pieces; repeated rows have pieces each. ``special`` is that of ``Encoder``.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * window

    def cut(kept: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        rows, piece, ids = [], [], []
        for row, found in enumerate(encoder(tokenizer, special).encode_all(texts)):
            whole = found + end
            for k, at in enumerate(range(0, len(whole), step)):
                rows.append(row)
                piece.append(k)
                ids.append(whole[at : at + step])
        number = pa.array(piece, pa.int32())
        columns = [c.take(pa.array(rows, pa.int32())) for c in kept.columns]
        start = pa.array([k * window for k in piece], pa.int64())
        length = pa.array([len(x) // 4 for x in ids], pa.int64())
        last = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array(ids, pa.binary())
        names = [*keep, "piece", "start", "length", "ids_crc32" if digest else "ids"]
        return pa.RecordBatch.from_arrays([*columns, number, start, length, last], names)

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema = f"{fields}piece int, start bigint, length bigint, {'ids_crc32 bigint' if digest else 'ids binary'}"
    return map_texts(docs, list(keep), text, schema, cut)


def plan_best_fit(counts: dict[int, int], window: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts, one row per run of like places.

    A row is (length, rank from, rank to, first sequence, offset, each): pieces of that length and those ranks go, ``each``
    by ``each``, to the sequences from the first on, beginning at the offset. Sequences with the same room are kept as runs
    of numbers; a length fills the runs with the least room that suffices and then new sequences. How many runs there are
    depends on which lengths occur, at most ``window``, and not on how many pieces there are.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room: runs (first sequence, how many)
    rooms: list[int] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, first, n = window, opened, left
            else:
                room = rooms[at]
                first, n = runs[room].pop()
            fit = room // length
            used, each = (min(n, left // fit), fit) if left >= fit else (1, left)
            yield length, rank, rank + used * each, first, window - room, each
            rank += used * each
            left -= used * each
            if first == opened:
                opened += used
            elif used < n:
                runs[room].append((first + used, n - used))
            if room in runs and not runs[room]:
                del runs[room]
                rooms.pop(at)
            if rest := room - each * length:
                if rest not in runs:
                    insort(rooms, rest)
                runs.setdefault(rest, []).append((first, used))


def pack(pieces: DataFrame, window: int = WINDOW, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (any columns, with ``length`` from 1 to ``window``).

    ``pieces`` is read twice, so pass a written table. Pieces of exactly ``window`` fill sequences of their own. Every
    piece is placed once; sequences are gapless from 0. ``order`` tells pieces of one length apart; rows equal in it may
    swap places. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = list(plan_best_fit(histogram, window))
    ranked = numbered(pieces, ["length"], list(order), bucket_count(sum(histogram.values())), "_rank")
    places = spark.createDataFrame(plan, PLAN).withColumnRenamed("length", "_length")
    if len(plan) <= BROADCAST_PLAN_ROWS:
        places = F.broadcast(places)
    sequence, offset = _placed()
    return ranked.join(places, (F.col("length") == F.col("_length")) & _inside()).select(
        *pieces.columns, sequence.alias("sequence_id"), offset.alias("offset")
    )


def _inside() -> Column:
    return (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))


def _placed() -> tuple[Column, Column]:
    """Sequence and offset of a piece by its rank and the plan's row."""
    nth = F.col("_rank") - F.col("rank_from")
    sequence = F.col("sequence_from") + F.call_function("div", nth, F.col("each"))
    return sequence, F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")


def pack_along(pieces: DataFrame, place: str, window: int = WINDOW, order: tuple[str, ...] = ("doc_id", "piece"), rows: int = STRETCH_ROWS) -> DataFrame:
    """``pack`` that keeps to an order: ``pieces`` are cut into stretches of ``rows`` numbers of ``place`` and each is packed by itself.

    So sequences up to any number hold what comes first, to within a stretch; the price is at most a few sequences a stretch
    that are not full. The stretches are planned in parallel, one histogram each. ``place`` holds whole numbers from 0.
    """
    near = pieces.withColumn("_stretch", F.call_function("div", F.col(place), F.lit(rows).cast("bigint")))

    def planned(counts):
        found = plan_best_fit(dict(zip(counts["length"].tolist(), counts["n"].tolist(), strict=True)), window)
        out = pd.DataFrame(found, columns=["_length", "rank_from", "rank_to", "sequence_from", "at", "each"])
        return out.assign(_stretch=counts["_stretch"].iloc[0])

    counts = near.groupBy("_stretch", "length").agg(F.count("*").alias("n"))
    plan = counts.groupBy("_stretch").applyInPandas(planned, f"{PLAN.replace('length', '_length', 1)}, _stretch bigint")
    plan = materialise(plan, "stretch-plans")
    last = F.col("sequence_from") + F.call_function("div", F.col("rank_to") - F.col("rank_from") - 1, F.col("each")) + 1
    sizes = plan.groupBy("_stretch").agg(F.max(last).alias("_n")).withColumn("_all", F.lit(0))
    bucket = F.call_function("div", F.col("_stretch"), F.lit(BUCKET_ROWS).cast("bigint"))
    starts = numbered(sizes, ["_all"], ["_stretch"], 0, "_k", ("_n", "_before"), bucket).select("_stretch", "_before")
    within = Window.partitionBy("_stretch", "length").orderBy(place, *order)
    ranked = near.withColumn("_rank", (F.row_number().over(within) - 1).cast("bigint"))
    sequence, offset = _placed()
    met = ranked.join(plan.withColumnRenamed("_stretch", "_of"), (F.col("_stretch") == F.col("_of")) & (F.col("length") == F.col("_length")) & _inside())
    return met.join(starts, "_stretch").select(*pieces.columns, (F.col("_before") + sequence).alias("sequence_id"), offset.alias("offset"))


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, special: bool = False, place: str | None = None
) -> DataFrame:
    """Pieces of all documents with their places and the crc32 of their ids; the ids stay in the Python workers.

    Null texts count as empty and have one piece, the end id; a long text is cut into pieces of ``window`` and a rest. Equal texts and
    repeated rows are packed each; a null doc_id is kept as it is. Rows alike in all that is returned may swap places. An
    empty table gives no rows. Other columns are not read. ``place`` names a column with the order wanted, see ``pack_along``.
    """
    keep = ("doc_id", place) if place else ("doc_id",)
    pieces = token_pieces(docs, tokenizer, end_id, window, keep=keep, special=special, digest=True)
    pieces, order = materialise(pieces, "pieces"), ("doc_id", "piece", "ids_crc32")
    return pack_along(pieces, place, window, order, STRETCH_ROWS).drop(place) if place else pack(pieces, window, order)
