"""Ordered per-key operators that survive a hot key.

A plain window sorts all rows of a key in one task. So the rows of each key are counted first, one narrow pass. Keys
within ``limit`` get the plain window. Rows of the others are range-partitioned on (key, order), which cuts a key, a
burst or even one instant into parts of about ``limit`` rows, and kept with ``checkpoint()`` so that the parts stay the same. The
window then runs per (key, part), and what a part needs from earlier ones comes from one summary row per part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.session import shared_dir

DEFAULT_LIMIT = 5_000_000


def attach(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``side``, one row per key; a NULL key meets a NULL key."""
    names = {key: f"__of_{key}" for key in keys}
    same = F.lit(True)
    for key, name in names.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    return rows.join(side.withColumnsRenamed(names), same, "left").drop(*names.values())


def split_hot(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int, sized_by: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and those of hot keys with their part as ``__part`` (None when no key is hot).

    ``sized_by`` holds at least the rows of ``df`` per key and is counted in its place, where it is cheaper to read.
    """
    counts = (df if sized_by is None else sized_by).groupBy(*keys).agg(F.count("*").alias("__n"))
    # At most total rows / limit keys come back.
    hot = counts.filter(F.col("__n") > limit).collect()
    if not hot:
        return df, None
    spark = df.sparkSession
    shared_dir(spark)
    names = [f"__hot_{i}" for i in range(len(keys))]
    known = F.broadcast(spark.createDataFrame(hot, counts.schema).drop("__n").toDF(*names))
    same = F.lit(True)
    for key, name in zip(keys, names):
        same = same & df[key].eqNullSafe(known[name])
    parts = math.ceil(sum(row["__n"] for row in hot) / limit) + 1
    crowded = (
        df.join(known, same, "left_semi")
        .repartitionByRange(parts, *keys, *order)
        .checkpoint()
        .withColumn("__part", F.spark_partition_id())
    )
    return df.join(known, same, "left_anti"), crowded


def _along(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    limit: int,
    inside: Callable[[WindowSpec], Column],
    summary: Column,
    carry: Callable[[Column, WindowSpec], Column],
    joined: Callable[[Column, Column], Column],
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add ``__out``: ``inside`` a window, joined in hot keys with what ``carry`` makes of earlier summaries."""
    plain, crowded = split_hot(df, keys, order, limit, sized_by)
    out = plain.withColumn("__out", inside(Window.partitionBy(*keys).orderBy(*order)))
    if crowded is None:
        return out
    per_part = crowded.groupBy(*keys, "__part").agg(summary.alias("__sum"))
    parts = [*keys, "__part"]
    carried = per_part.select(
        *parts, carry(F.col("__sum"), Window.partitionBy(*keys).orderBy("__part")).alias("__carry")
    )
    wide = attach(crowded, carried, parts)
    here = inside(Window.partitionBy(*keys, "__part").orderBy(*order))
    hot = wide.withColumn("__here", here).withColumn("__out", joined(F.col("__here"), F.col("__carry")))
    return out.unionByName(hot.select(*out.columns))


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Values of the preceding row of the same key. ``columns`` maps a column to the name of its earlier value.

    Also adds ``has_previous``, since an earlier value may itself be NULL.
    """
    seen = F.struct(*columns)
    out = _along(
        df,
        keys,
        order,
        limit,
        inside=lambda w: F.lag(seen).over(w),
        summary=F.max_by(seen, F.struct(*order)),
        carry=lambda s, w: F.lag(s).over(w),
        joined=F.coalesce,
    )
    return out.select(
        *df.columns,
        *[F.col(f"__out.{source}").alias(target) for source, target in columns.items()],
        F.col("__out").isNotNull().alias("has_previous"),
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    include_current: bool = True,
    limit: int = DEFAULT_LIMIT,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to this one (or up to the one before it)."""
    last = Window.currentRow if include_current else -1
    start = Window.unboundedPreceding
    summed = _along(
        df.withColumn("__v", value),
        keys,
        order,
        limit,
        inside=lambda w: F.coalesce(F.sum("__v").over(w.rowsBetween(start, last)), F.lit(0)),
        summary=F.sum("__v"),
        carry=lambda s, w: F.sum(s).over(w.rowsBetween(start, -1)),
        joined=lambda here, before: here + F.coalesce(before, F.lit(0)),
        sized_by=sized_by,
    )
    return summed.select(*df.columns, F.col("__out").alias(out))


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Latest non-NULL ``value`` of the key up to and including this row."""
    start = Window.unboundedPreceding
    known = _along(
        df.withColumn("__v", value),
        keys,
        order,
        limit,
        inside=lambda w: F.last("__v", ignorenulls=True).over(w.rowsBetween(start, Window.currentRow)),
        summary=F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(start, -1)),
        joined=F.coalesce,
    )
    return known.select(*df.columns, F.col("__out").alias(out))
