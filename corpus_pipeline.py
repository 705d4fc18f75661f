"""The corpus pipeline: quality rules, exact copies, near copies, mixing, packing.

Each stage reads all that the stage before it wrote; all but the last return the columns of ``documents``. Every stage takes
any further columns along, whatever their names, gives no rows for an empty table, counts a null text as empty, and
reads long texts whole; what it does with ties, repeated rows and nulls elsewhere is said at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import exact_dedup, mixing, ngram_join, packing, quality
from tidewatch.llm.queries import MIX_BLOCK, MIX_PARTS, WORD_BPE, WORD_END_ID
from tidewatch.session import materialise

#: SQL can't encode texts; the test holds the run against a plain version instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go.

    A null or empty text has no words and goes. Repeated rows are judged alike. A null language is a stratum of its own.
    """
    return quality.without_bad(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case) the row with the largest doc_id stays, a null doc_id only where there is no other.

    Of rows that share that doc_id and text one stays.
    """
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the largest doc_id stays.

    A group is what is linked by a similarity of 0.8 or more over five words, directly or by others. Texts without words are a
    group; a null doc_id ranks lowest; of repeated rows one stays.
    """
    return ngram_join.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, put in the order that holds the sources' target weights.

    The order is that of the rows in the files the stage is written to; the next stage goes by it. A null source is one of its own.
    Repeated rows stay next to each other and one of them is kept, as the stages before left none.
    """
    return mixing.mixed(docs, mixing.damped_weights(docs, MIX_PARTS), MIX_BLOCK)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences, which are numbered along the mixture.

    Documents take places in the order in which the mixture's files hold them, so the sequences up to any number hold the
    sources by about their weights. An empty text has one piece, the end id; a longer one than a sequence is cut.
    """
    placed = mixing.stored_place(docs, "_place").select("doc_id", "text", "_place")
    return packing.pack_documents(placed, public_tokenizers.path(WORD_BPE), WORD_END_ID, special=True, place="_place")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
