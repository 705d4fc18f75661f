"""Sharding indivisible groups by Karmarkar-Karp differencing, in two levels.

A partial partition holds one sum per shard. Differencing takes the two with the largest spread (largest sum less smallest)
and adds them oppositely ordered, largest to smallest. Groups are dealt by a hash to buckets of bounded size; each bucket
is differenced in a task down to one partial partition, whose spread is about that of its last items. What remains, a few
numbers per bucket, is differenced the same way, and each bucket's subsets get their shards.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bucket_count, numbered
from tidewatch.session import materialise

#: Groups of a bucket, and partial partitions of a bucket on the levels above.
BUCKET_GROUPS = 4096
FAN = 1024


def difference(sums: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions of equally many sums, largest spread first, oppositely ordered.

    Gives the sums of the result, ascending, and for each input the place each of its sums ended in. Equal spreads are
    taken in input order.
    """
    k = len(sums[0])
    heap, made = [], []
    for number, values in enumerate(sums):
        order = sorted(range(k), key=values.__getitem__)
        made.append(order)
        low = [values[i] for i in order]
        heap.append((low[0] - low[-1], number, low))
    heapq.heapify(heap)
    n, joins = len(sums), []
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        mixed = [x + y for x, y in zip(left, reversed(right), strict=True)]
        order = sorted(range(k), key=mixed.__getitem__)
        low = [mixed[i] for i in order]
        joins.append((a, b, order))
        heapq.heappush(heap, (low[0] - low[-1], n + len(joins) - 1, low))
    places: dict[int, list[int]] = {n + len(joins) - 1: list(range(k))}
    for at in range(len(joins) - 1, -1, -1):
        a, b, order = joins[at]
        mine = places.pop(n + at)
        to = [0] * k
        for place, old in enumerate(order):
            to[old] = mine[place]
        places[a], places[b] = to, to[::-1]
    out = []
    for number, order in enumerate(made):
        where = [0] * k
        for place, old in enumerate(order):
            where[old] = places[number][place]
        out.append(where)
    return heap[0][2], out


def _deal_items(shards: int):
    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "g"], ascending=[False, True], kind="stable")
        sizes = rows["bytes"].tolist()
        _, places = difference([[0] * (shards - 1) + [size] for size in sizes])
        return pd.DataFrame({"g": rows["g"], "bucket": rows["bucket"], "subset": [p[-1] for p in places], "bytes": sizes})

    return deal


def _deal_partitions(shards: int):
    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket", kind="stable")
        low, places = difference([list(x) for x in rows["sums"]])
        return pd.DataFrame({"bucket": rows["bucket"], "above": rows["above"], "places": places, "sums": [low] * len(rows)})

    return deal


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(g, shard) of groups (g, bytes), near equal in bytes; ``g`` is a non-null key of one row, ``groups`` a written table.

    A group heavier than a shard's fair share sits alone as far as the others allow; nothing can balance beyond it.
    """
    kind = groups.schema["g"].dataType.simpleString()
    buckets = max(1, -(-groups.count() // BUCKET_GROUPS))
    dealt = groups.select("g", "bytes", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("bigint").alias("bucket"))
    items = dealt.groupBy("bucket").applyInPandas(_deal_items(shards), f"g {kind}, bucket bigint, subset int, bytes bigint")
    items = materialise(items, "shard-items")
    level = items.groupBy("bucket", "subset").agg(F.sum("bytes").alias("sum"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("bigint")))
    level = level.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("subset", "sum"))).alias("m"))
    level = level.select("bucket", slots.alias("sums"))
    maps, n = [], buckets
    while n > 1:
        n = -(-n // FAN)
        above = level.withColumn("above", F.pmod(F.col("bucket"), F.lit(n)))
        schema = "bucket bigint, above bigint, places array<int>, sums array<bigint>"
        solved = materialise(above.groupBy("above").applyInPandas(_deal_partitions(shards), schema), "shard-level")
        maps.append(solved.select("bucket", "above", "places"))
        level = solved.groupBy(F.col("above").alias("bucket")).agg(F.any_value("sums").alias("sums"))
    if not maps:
        return items.select("g", F.col("subset").alias("shard"))
    known = maps[-1].select("bucket", "places")
    for lower in reversed(maps[:-1]):
        upper = known.select(F.col("bucket").alias("above"), F.col("places").alias("_up"))
        moved = F.transform("places", lambda i: F.get("_up", i))
        known = lower.join(upper, "above").select("bucket", moved.alias("places"))
    return items.join(known, "bucket").select("g", F.get("places", F.col("subset")).alias("shard"))


def shard_documents(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """Put whole groups of equal texts into ``shards`` shards of near equal bytes.

    One row per row of ``docs``: doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32, shard from 0 and
    slot, gapless from 0 within the shard. A null text counts as empty. Repeated rows are rows. Other columns are not read. An
    empty table gives no rows. Groups are told apart by the sha256 of their text.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    size = (F.octet_length(whole) + 8).cast("bigint")
    rows = docs.select(
        F.col("doc_id"), size.alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(whole, 256)).alias("g")
    )
    rows = materialise(rows, "shard-rows")
    groups = materialise(rows.groupBy("g").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = materialise(assign_groups(groups, shards), "shard-groups-placed")
    sharded = rows.join(placed, "g")
    out = numbered(sharded, ["shard"], ["doc_id", "g"], bucket_count(rows.count()), "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
