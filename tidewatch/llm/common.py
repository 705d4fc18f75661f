"""What several operators share: reading tables, gapless numbers and prefix sums over hot keys, the query registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Fixed value that stands for a null doc_id, below all others.
NO_ID = -(2**63)
#: Rows of a bucket that one window sorts.
BUCKET_ROWS = 10_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, its SQL check."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def row_key(docs: DataFrame, text: Column) -> list[Column]:
    """(_id, _x): the doc_id, with the least number for null, and a hash that tells rows of one id apart."""
    return [F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_x")]


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that no column added beside it can clash."""
    return F.struct(*[docs[c] for c in docs.columns]).alias("_row")


def bucket_count(rows: int) -> int:
    """Buckets that keep a bucket of evenly hashed rows near BUCKET_ROWS."""
    return max(1, -(-rows // BUCKET_ROWS))


def numbered(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    buckets: int,
    number: str,
    total: tuple[str, str] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``number``, gapless from 0 within ``keys``, and for ``total=(size, name)`` the sum of sizes before the row.

    A key may hold most rows, so its rows are dealt by a hash of ``order`` (or ``bucket``) to ``buckets`` buckets. Each bucket is
    numbered by itself and starts where the buckets before it end; only one row per key and bucket is summed up per key.
    The numbers follow (bucket, ``order``). ``keys`` must not be null; ``order`` should tell rows apart, rows equal in
    it are numbered in any order.
    """
    if bucket is None:
        bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    dealt = rows.withColumn("_bucket", bucket)
    group = [*keys, "_bucket"]
    sums = [F.count("*").alias("_rows")] + ([F.sum(total[0]).alias("_size")] if total else [])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*group).agg(*sums)
    starts = starts.select(
        *group,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"),
        *([F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")] if total else []),
    )
    within = Window.partitionBy(*group).orderBy(*order)
    out = dealt.join(starts, group)
    added = {number: F.col("_first") + F.row_number().over(within) - 1}
    if total:
        earlier = within.rowsBetween(Window.unboundedPreceding, -1)
        added[total[1]] = F.col("_start") + F.coalesce(F.sum(total[0]).over(earlier), F.lit(0))
    return out.withColumns(added).drop("_bucket", "_first", "_start")
