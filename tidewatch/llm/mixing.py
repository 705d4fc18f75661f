"""Mixing sources to target weights by Pfair scheduling of blocks.

A source of weight w gives its k-th block no earlier than floor(k / w) and no later than ceil((k + 1) / w). Giving each slot
to the released block with the earliest deadline keeps every source within less than one block of its share at every
slot. Weights are whole parts of a period, so the schedule repeats and one period is all that is worked out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import as_row, bound_once, bucket_count, numbered, row_key
from tidewatch.session import materialise

#: Fixed value that stands for a null source.
NO_SOURCE = ""
#: Hex digits of the order hash that deal rows to buckets.
DIGITS = 7
#: Slots of the schedule that are picked before they are put together.
SEGMENT = 1024


def damped_weights(docs: DataFrame, parts: int) -> DataFrame:
    """(source, parts): shares of about ``parts`` in proportion to the root of each source's bytes, one part at least."""
    sizes = _sized(docs).groupBy("source").agg(F.sqrt(F.sum("size")).alias("root"))
    share = F.round(F.col("root") / F.sum("root").over(Window.partitionBy(F.lit(1))) * parts)
    return sizes.select("source", F.greatest(share, F.lit(1)).cast("bigint").alias("parts"))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        *row_key(docs, text), F.coalesce(docs["source"], F.lit(NO_SOURCE)).alias("source"), F.octet_length(text).cast("bigint").alias("size")
    )


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def schedule(weights: DataFrame) -> DataFrame:
    """(source, parts, period, slots): the slots of each source's blocks within a period.

    Earliest deadline first over one period, ties to the source that comes first by name, as a fold over its slots. Sources of
    equal weight have equal releases and deadlines and take turns by name, so the fold keeps one counter per weight: sums
    of different weights make up the period, so there are fewer of them than the root of twice the period. Slots are picked
    SEGMENT at a time and then put together. The table has one row per source, whatever the data.
    """
    named = F.sort_array(F.collect_list(F.struct("parts", "names")))
    classes = weights.groupBy("parts").agg(F.sort_array(F.collect_list("source")).alias("names"))
    one = classes.agg(named.alias("s"), F.sum(F.col("parts") * F.size("names")).alias("period")).filter("period > 0")
    zero, period = F.lit(0).cast("bigint"), F.col("period")
    nothing = F.array().cast("array<struct<i:int,m:int>>")
    start = F.struct(F.transform("s", lambda _: zero).alias("given"), nothing.alias("picks"))

    def step(state: Column, t: Column) -> Column:
        def of(each: Column, i: Column) -> Column:
            given, parts, members = F.get(state["given"], i), each["parts"], F.size(each["names"])
            k, m = _div(given, members), F.pmod(given, members).cast("int")
            deadline = _div((k + 1) * period + parts - 1, parts)
            return F.when(_div(k * period, parts) <= t, F.struct(deadline.alias("deadline"), F.get(each["names"], m).alias("name"), i.alias("i"), m.alias("m")))

        return bound_once(
            F.array_min(F.transform("s", of)),
            lambda p: F.struct(
                F.transform(state["given"], lambda g, i: F.when(i == p["i"], g + 1).otherwise(g)).alias("given"),
                F.array_append(state["picks"], F.struct(p["i"].alias("i"), p["m"].alias("m"))).alias("picks"),
            ),
        )

    def segment(state: Column, first: Column) -> Column:
        slots = F.sequence(first, F.least(first + SEGMENT, period) - 1)
        picked = F.aggregate(slots, F.struct(state["given"].alias("given"), nothing.alias("picks")), step)
        return bound_once(picked, lambda p: F.struct(p["given"].alias("given"), F.concat(state["picks"], p["picks"]).alias("picks")))

    firsts = F.sequence(zero, period - 1, F.lit(SEGMENT).cast("bigint"))
    dealt = one.select("s", "period", F.aggregate(firsts, start, segment)["picks"].alias("picks"))
    each = dealt.select("s", "period", F.posexplode("picks").alias("slot", "p"))
    each = each.select(F.get("s", F.col("p.i")).alias("w"), F.col("p.m").alias("m"), "period", F.col("slot").cast("bigint").alias("slot"))
    each = each.select(F.get("w.names", F.col("m")).alias("source"), F.col("w.parts").alias("parts"), "period", "slot")
    return each.groupBy("source", "parts", "period").agg(F.sort_array(F.collect_list("slot")).alias("slots"))


def slot_of(block: Column) -> Column:
    """Slot of a source's block, beside the columns of its schedule."""
    return _div(block, F.col("parts")) * F.col("period") + F.get("slots", F.pmod(block, F.col("parts")).cast("int"))


def mix(docs: DataFrame, weights: DataFrame, block_bytes: int) -> DataFrame:
    """The place of every row in the mixture: (_id, _x, source, size, block, slot, place, on_target).

    Each source is put in order by the md5 of its doc_ids and cut into blocks of ``block_bytes`` bytes of text (a row belongs
    to the block it begins in). ``weights`` (source, parts) gives whole parts, at least 1, of every source that occurs. At
    every slot each source that still has blocks deviates from its share of the slots by less than one block. A source
    that runs out leaves its slots empty and the others keep their order, so no row is dropped or repeated; ``on_target`` is
    true before the first slot that a source had to leave empty. Sort by (slot, place).

    Null sources are one source, null texts have no bytes, null doc_ids rank as the least number. No rows, no result.
    """
    rows = materialise(_sized(docs).withColumn("_md5", F.md5(F.col("_id").cast("string"))), "mix-rows")
    plan = materialise(schedule(weights), "mix-schedule")
    buckets = bucket_count(rows.count())
    hashed = F.conv(F.substring("_md5", 1, DIGITS), 16, 10).cast("bigint")
    bucket = F.floor(hashed * F.lit(buckets) / F.lit(16**DIGITS))
    ranked = numbered(rows, ["source"], ["_md5", "_id", "_x"], buckets, "place", ("size", "_before"), bucket)
    blocks = ranked.withColumn("block", _div(F.col("_before"), F.lit(block_bytes).cast("bigint")))
    blocks = materialise(blocks.drop("_before", "_md5"), "mix-blocks")
    ends = blocks.groupBy("source").agg((F.max("block") + 1).alias("_next")).join(plan, "source")
    horizon = ends.agg(F.min(slot_of(F.col("_next"))).alias("h")).first()["h"]
    placed = blocks.join(plan, "source").withColumn("slot", slot_of(F.col("block")))
    return placed.select(
        "_id", "_x", "source", "size", "block", "slot", "place", (F.col("slot") < F.lit(horizon)).alias("on_target")
    )


def mixed(docs: DataFrame, weights: DataFrame, block_bytes: int) -> DataFrame:
    """All rows of ``docs`` with their own columns, range-partitioned and sorted in the order of the mixture."""
    places = mix(docs, weights, block_bytes).select("_id", "_x", "slot", "place").dropDuplicates(["_id", "_x"])
    rows = docs.select(as_row(docs), *row_key(docs, F.coalesce(docs["text"], F.lit(""))))
    ordered = rows.join(places, ["_id", "_x"]).select("_row", "slot", "place")
    return ordered.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("_row.*")


def stored_place(docs: DataFrame, name: str) -> DataFrame:
    """Add the place of each row in the Parquet files it is read from: the number of its part and the row in it.

    A mixture that was written as ``mixed`` gives it has its order in its files: Spark numbers parts as it orders ranges.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint")
    return docs.withColumn(name, F.shiftleft(part, 40) + F.col("_metadata.row_index"))
