"""A registry kept by a stream: last write of each key, as a versioned table of buckets.

Keys are dealt to a fixed number of buckets by hash. Each micro-batch rewrites the buckets it touches into a folder of its
own and then adds a manifest that names the folder of every bucket. A reader goes by the newest manifest, so it sees whole
batches only. A batch that is run again finds its manifest and changes nothing; one that failed before it is written over.

    path/data/batch=N/bucket=B/...     path/manifests/batch=N/...
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidewatch.sources.registry import upsert

BUCKETS = 64
MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("written", T.LongType())])
BATCH = T.StructField("batch", T.LongType())


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """Number of the newest batch (-1 for none) and the batch that wrote each bucket; at most BUCKETS rows come back."""
    try:
        found = spark.read.schema(T.StructType([*MANIFEST.fields, BATCH])).parquet(f"{path}/manifests")
    except AnalysisException:
        return -1, {}
    newest = found.agg(F.max("batch")).first()[0]
    if newest is None:
        return -1, {}
    return newest, {r["bucket"]: r["written"] for r in found.filter(F.col("batch") == newest).collect()}


def _buckets(spark: SparkSession, path: str, schema: T.StructType, places: dict[int, int]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/batch={n}/bucket={b}" for b, n in sorted(places.items())])


def merge_batch(writes: DataFrame, batch: int, path: str, key: str = "job_id", order: Sequence[str] = ("ts", "seq"), buckets: int = BUCKETS) -> None:
    """Merge a batch of writes into the snapshot; of writes and stored rows of a key the last by ``order`` stays.

    The buckets' number may not change over the life of a snapshot. Only touched buckets are read and written.
    """
    spark = writes.sparkSession
    newest, places = _manifest(spark, path)
    if newest >= batch:
        return
    number = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    last = upsert(writes, key, order).select(*writes.columns).withColumn("bucket", number).persist()
    try:
        touched = [r["bucket"] for r in last.select("bucket").distinct().collect()]  # at most ``buckets``
        old = _buckets(spark, path, writes.schema, {b: places[b] for b in touched if b in places})
        merged = upsert(last.drop("bucket").unionByName(old), key, order).select(*writes.columns)
        merged = merged.withColumn("bucket", number).repartition(max(1, len(touched)), "bucket")
        if touched:
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={batch}")
        entries = sorted((places | dict.fromkeys(touched, batch)).items())
        spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/batch={batch}")
    finally:
        last.unpersist()


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The registry as of the newest whole batch."""
    shape = spark.createDataFrame([], schema).schema
    return _buckets(spark, path, shape, _manifest(spark, path)[1])


def keep_snapshot(writes: DataFrame, path: str, checkpoint: str, key: str = "job_id", order: Sequence[str] = ("ts", "seq"), buckets: int = BUCKETS, every: str | None = None):
    """Start a stream that keeps the snapshot at ``path``: over what is there, or ``every`` so often for good."""
    writer = writes.writeStream.foreachBatch(lambda frame, batch: merge_batch(frame, batch, path, key, order, buckets))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def divert_late(rows: DataFrame, batch: int, path: str, ts: str, late: str) -> None:
    """Write the rows of a batch that a watermark of ``late`` drops: those not after the latest time of earlier batches less it.

    Each batch leaves its latest time and its late rows in folders of its own, so one that is run again writes the same.
    """
    spark = rows.sparkSession
    rows = rows.persist()
    try:
        shape = T.StructType([T.StructField("latest", T.TimestampType()), BATCH])
        rows.agg(F.max(F.col(ts).cast("timestamp")).alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/times/batch={batch}")
        times = spark.read.schema(shape).parquet(f"{path}/times").filter(F.col("batch") < batch)
        mark = times.agg((F.max("latest") - F.expr(f"interval {late}")).alias("mark")).first()["mark"]
        dropped = rows.filter(F.lit(False)) if mark is None else rows.filter(F.date_trunc("millisecond", F.col(ts).cast("timestamp")) <= F.date_trunc("millisecond", F.lit(mark)))
        dropped.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    finally:
        rows.unpersist()


def write_late(rows: DataFrame, path: str, checkpoint: str, ts: str = "ts", late: str = "1 hour"):
    """Start a stream that keeps the late rows of a feed at ``path``/rows, beside the one that drops them."""
    writer = rows.writeStream.foreachBatch(lambda frame, batch: divert_late(frame, batch, path, ts, late))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_late(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Late rows with the ``batch`` they came in."""
    return spark.read.schema(T.StructType([*schema.fields, BATCH])).parquet(f"{path}/rows")
