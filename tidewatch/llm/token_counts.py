"""Token counts: an exact length histogram whose suffix sums answer every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tokens import encoder, map_texts

#: Lengths of a block; blocks are summed up first, so no window holds more rows than this or than there are blocks.
LENGTH_BLOCK = 4096


def token_lengths(docs: DataFrame, path: str, keep: list[str], text: str = "text", special: bool = False) -> DataFrame:
    """``keep`` and ``n_tokens``, the encoded length of each whole text; null and empty texts have length 0.

    ``special`` is that of ``Encoder``.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def count(kept: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        sizes = pa.array([len(ids) // 4 for ids in encoder(path, special).encode_all(texts)], pa.int64())
        return pa.RecordBatch.from_arrays([*kept.columns, sizes], [*keep, "n_tokens"])

    return map_texts(docs, keep, text, f"{fields + ', ' if fields else ''}n_tokens bigint", count)


def length_histogram(lengths: DataFrame, by: list[str]) -> DataFrame:
    """One row per group and length: how many texts. Reduced before the shuffle, so a hot group costs no more."""
    return lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))


def limit_table(histogram: DataFrame, by: list[str]) -> DataFrame:
    """For each length that occurs, taken as the context limit, what it keeps of its group.

    Columns besides ``by``, ``n_tokens`` (the limit) and ``n_docs`` (texts of exactly that length): ``docs_longer`` and
    ``tokens_longer`` (suffix sums), ``docs_total``, ``tokens_total``, ``tokens_truncated`` (tokens left when every text
    is cut at the limit), ``tokens_whole`` (tokens of texts that fit) and ``quantile`` (share of texts that fit). Limits
    between two lengths follow from the next lower row, see ``at_limit``; no text is drawn or left out. An empty table
    gives no rows; null groups are a group.
    """
    size = F.col("n_docs") * F.col("n_tokens")
    rows = histogram.withColumn("_block", F.floor(F.col("n_tokens") / LENGTH_BLOCK))
    blocks = rows.groupBy(*by, "_block").agg(F.sum("n_docs").alias("_d"), F.sum(size).alias("_t"))
    later = Window.partitionBy(*by).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    blocks = blocks.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("_block").alias("_at"),
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(whole).alias("docs_total"),
        F.sum("_t").over(whole).alias("tokens_total"),
    )
    same = F.col("_block") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    above = Window.partitionBy(*by, "_block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.col("_docs_after") + F.coalesce(F.sum("n_docs").over(above), F.lit(0))
    tokens = F.col("_tokens_after") + F.coalesce(F.sum(size).over(above), F.lit(0))
    out = rows.join(blocks, same).withColumns({"docs_longer": longer, "tokens_longer": tokens})
    kept = F.col("tokens_total") - F.col("tokens_longer")
    return out.select(
        *by,
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        "docs_total",
        "tokens_total",
        (kept + F.col("docs_longer") * F.col("n_tokens")).alias("tokens_truncated"),
        kept.alias("tokens_whole"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile"),
    )


def at_limit(limits: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Totals of each group when texts are cut at ``limit``, whether or not a text has that length."""
    below = limits.filter(F.col("n_tokens") <= limit).groupBy(*by).agg(F.max_by("docs_longer", "n_tokens").alias("_dl"), F.max_by("tokens_whole", "n_tokens").alias("_tw"))
    totals = limits.groupBy(*by).agg(F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total"))
    longer = F.coalesce("_dl", "docs_total")
    joined = totals.join(below, _same(totals, below, by), "left")
    return joined.select(
        *[totals[c] for c in by],
        longer.alias("docs_longer"),
        (F.coalesce("_tw", F.lit(0)) + longer * F.lit(limit)).alias("tokens_truncated"),
        "tokens_total",
    )


def quantile_lengths(limits: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """The least length at or below which ``quantile`` of a group's texts lie."""
    return limits.filter(F.col("quantile") >= quantile).groupBy(*by).agg(F.min("n_tokens").alias("n_tokens"))


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & a[c].eqNullSafe(b[c])
    return same
