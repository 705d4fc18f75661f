"""Language identification by compression: a text belongs to the language whose dictionary compresses it best.

Each language has a raw-content zstandard dictionary made of labelled text. A text is cut into blocks, every block is
compressed with each dictionary on its own, and the sizes are added up. The smallest sum wins; where the runner-up is too
close the text is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tokens import STEP

UNKNOWN = "und"
#: Bytes of a dictionary and of all of them; with more languages than 256 each dictionary is smaller, and none is left out.
DICTIONARY_BYTES = 1 << 17
ALL_BYTES = 1 << 25
#: Documents drawn per language at most, and characters that one may give to a dictionary.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 512
#: Languages whose numbers may be broadcast; those of more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
#: Characters of a block: short, so that what a text repeats of itself counts little beside the dictionary.
BLOCK = 128
LEVEL = 9
MIN_MATCH = 3
#: Least saving over the runner-up, as a share of its size, that is not rejected.
MARGIN = 0.01


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, bytes]:
    """A dictionary per language from a bounded sample of the labelled rows, most frequent language first.

    A text gives its first SAMPLE_CHARS characters; equal ones of a language count once, however often they are copied. The
    SAMPLE_DOCS of them with the least hashes are drawn, so every language gives at least one. Only the sample is cut;
    predictions read whole texts. Every language is learned: its dictionary has DICTIONARY_BYTES, or its part of ALL_BYTES where
    there are many, and is cut before it comes to the driver. Rows without language or letters are not used. No labelled
    rows, no dictionaries.
    """
    labelled = docs.filter(docs[lang].isNotNull() & has_letter(docs[text]))
    rows = labelled.select(docs[lang].alias("lang"), F.substring(docs[text], 1, SAMPLE_CHARS).alias("text"))
    rows = rows.withColumn("hash", F.pmod(F.xxhash64("text"), F.lit(2**31)))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("texts"))
    sizes = counts.orderBy(F.desc("n"), "lang").collect()  # one row per language, as many as the model has
    share = min(DICTIONARY_BYTES, ALL_BYTES // max(1, len(sizes)))
    wanted = min(SAMPLE_DOCS, max(1, 4 * share // SAMPLE_CHARS))
    # Twice as many as wanted, as the number of texts is an estimate.
    rates = docs.sparkSession.createDataFrame([(r["lang"], 2 * wanted / max(1, r["texts"]) * 2**31) for r in sizes], "lang string, below double")
    rates = F.broadcast(rates) if len(sizes) <= BROADCAST_LANGUAGES else rates
    drawn = rows.join(rates, "lang").filter("hash < below").select("lang", "hash", "text").distinct()
    least = F.slice(F.sort_array(F.collect_list(F.struct("hash", "text"))), 1, wanted)
    joined = drawn.groupBy("lang").agg(F.encode(F.array_join(least["text"], "\n"), "utf-8").alias("all"))
    ends = F.when(F.octet_length("all") > share, F.substring("all", -share, share)).otherwise(F.col("all"))
    parts = {r["lang"]: bytes(r["end"]) for r in joined.select("lang", ends.alias("end")).collect()}
    return {r["lang"]: parts[r["lang"]] for r in sizes if r["lang"] in parts}


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class Sizes:
    """Compressed bytes of a text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as zstd

        self.languages = list(dictionaries)
        params = zstd.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False)
        self.tools = []
        for data in dictionaries.values():
            made = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=params)
            self.tools.append(zstd.ZstdCompressor(dict_data=made, compression_params=params))

    def __call__(self, text: str) -> list[int]:
        totals = [0] * len(self.tools)
        for at in range(0, len(text), BLOCK):
            data = text[at : at + BLOCK].encode()
            for k, tool in enumerate(self.tools):
                totals[k] += len(tool.compress(data))
        return totals


def verdict(sizes: list[int], languages: list[str]) -> tuple[str, float, bool]:
    """(language, score, rejected): the score is 1/2 for a tie with the runner-up and nears 1 with its saving over it."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    best = sizes[order[0]]
    if len(order) == 1:
        return languages[order[0]], 1.0, False
    saving = (sizes[order[1]] - best) / sizes[order[1]]
    return languages[order[0]], min(1.0, 0.5 + 5 * saving), saving < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and (lang_pred, score, rejected) of every whole text; no shuffle.

    A null text or one without letters is ``und`` with score 0 and rejected, as are all when nothing was learned. Ties go to
    the more frequent language. A long text is read a block at a time; repeated rows are predicted each; an empty table
    gives no rows. Columns not in ``keep`` are not read; a name in ``keep`` must not be that of a column added here.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(sent.value)
        for batch in batches:
            for first in range(0, batch.num_rows, STEP):
                part = batch.slice(first, STEP)
                texts, letters = (part.column(len(keep) + k).to_pylist() for k in (0, 1))
                found = [
                    verdict(sizes(t), sizes.languages) if ok and sizes.languages else (UNKNOWN, 0.0, True)
                    for t, ok in zip(texts, letters, strict=True)
                ]
                columns = [*part.columns[: len(keep)], *map(pa.array, zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "rejected"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    source = docs.select(*keep, docs[text].alias("_text"), has_letter(docs[text]).alias("_letter"))
    return source.mapInArrow(predict, f"{fields}lang_pred string, score double, rejected boolean")
