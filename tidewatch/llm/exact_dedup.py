"""Exact dedup by composable polynomial fingerprints, confirmed by comparing texts chunk by chunk.

The fingerprint of bytes ``c0 c1 ... cn`` is ``sum(ci * base^(n-i))`` modulo two primes. It composes: ``A + B`` has the
fingerprint ``fp(A) * base^len(B) + fp(B)``. So chunks of a huge document are hashed as rows of their own, in any task, and
their hashes are put together with length-shifted arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BUCKET_ROWS, NO_ID, as_row, row_key
from tidewatch.session import materialise

#: Characters of a chunk.
CHUNK = 1 << 16
#: Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 40009007)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower case of A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def chunks_of(text: Column, chunk: int) -> Column:
    """A text as consecutive chunks of ``chunk`` characters; an empty one has one empty chunk."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    return F.when(F.length(text) <= chunk, F.array(text)).otherwise(parts)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^(n-1) ... base^0, by doubling."""
    up = np.ones(1, np.int64)
    while len(up) < n:
        step = pow(base, len(up), prime)
        up = np.concatenate([up, up * step % prime])
    return up[:n][::-1].copy()


class Hasher:
    """Hash and shift of byte strings under one prime."""

    def __init__(self, base: int, prime: int, span: int = 1 << 14):
        self.base, self.prime, self.span = base, prime, span
        self.powers = _powers(base, prime, span)
        self.shift = pow(base, span, prime)

    def __call__(self, data: np.ndarray) -> tuple[int, int]:
        """(hash, base^length): a product of a byte and a power stays below 2^39, so a span's sum fits 64 bits."""
        total = 0
        for at in range(0, len(data), self.span):
            part = data[at : at + self.span].astype(np.int64)
            shift = self.shift if len(part) == self.span else pow(self.base, len(part), self.prime)
            total = (total * shift + int(part @ self.powers[self.span - len(part) :])) % self.prime
        return total, pow(self.base, len(data), self.prime)


def compose(left: tuple[int, int], right: tuple[int, int], prime: int) -> tuple[int, int]:
    """(hash, shift) of two byte strings put together."""
    return (left[0] * right[1] + right[0]) % prime, left[1] * right[1] % prime


def _composed(parts: Column, k: int) -> Column:
    """The same over an array of structs (h<k>, s<k>), in order, as one column."""
    return F.aggregate(
        parts, F.lit(0).cast("bigint"), lambda acc, part: F.pmod(acc * part[f"s{k}"] + part[f"h{k}"], F.lit(PRIMES[k]))
    )


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashers = [Hasher(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
    for batch in batches:
        found: list[list[int]] = [[], [], [], []]
        for value in batch.column(batch.num_columns - 1):
            data = np.frombuffer(value.as_buffer(), np.uint8)
            for k, hasher in enumerate(hashers):
                for column, number in zip(found[2 * k :], hasher(data), strict=False):
                    column.append(number)
        hashes = [pa.array(x, pa.int64()) for x in found]
        names = [*batch.schema.names[:-1], "h0", "s0", "h1", "s1"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *hashes], names)


PRINT = ["f0", "f1", "n_bytes"]


def keyed(docs: DataFrame) -> DataFrame:
    """(_id, _x, _t): the id without nulls, a hash that tells rows of one id apart, the normalised text."""
    text = normalised(docs["text"])
    return docs.select(*row_key(docs, text), text.alias("_t"))


def fingerprints(docs: DataFrame, chunk: int = CHUNK, digest: bool = False) -> DataFrame:
    """(row, _id, _x, n_bytes, f0, f1) of every row's normalised text, and its sha256 when ``digest`` is asked for.

    A text of up to ``chunk`` characters is hashed where it lies. The chunks of longer ones are rows of their own, dealt to all
    tasks and hashed there, and put together afterwards by their lengths. ``row`` tells rows apart within the result and may
    differ from run to run, so write the result before it is used twice.
    """
    size = F.coalesce(F.length(docs["text"]), F.lit(0))
    number = F.monotonically_increasing_id()
    whole = ["row", "_id", "_x", "n_bytes", *(["text_sha256"] if digest else [])]

    def rows(part: DataFrame, row: Column) -> DataFrame:
        found = keyed(part).withColumns({"n_bytes": F.octet_length("_t"), "row": row})
        return found.withColumn("text_sha256", F.sha2(F.col("_t"), 256)) if digest else found

    short = _hashed(rows(docs.filter(size <= chunk), number).select(*whole, F.col("_t").alias("c")))
    pieces = rows(docs.filter(size > chunk), -1 - number).select(*whole, F.posexplode(chunks_of(F.col("_t"), chunk)).alias("k", "c"))
    long = _hashed(pieces.repartition("row", "k"))
    parts = F.sort_array(F.collect_list(F.struct("k", "h0", "s0", "h1", "s1")))
    grouped = long.groupBy("row").agg(*[F.any_value(c).alias(c) for c in whole[1:]], parts.alias("_p"))
    composed = grouped.select(*whole, *[_composed(F.col("_p"), k).alias(f"f{k}") for k in (0, 1)])
    return short.select(*whole, F.col("h0").alias("f0"), F.col("h1").alias("f1")).unionByName(composed)


def _hashed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with hash and shift of ``c``, which comes last and goes."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.drop("c").schema)
    return pieces.withColumn("c", F.col("c").cast("binary")).mapInArrow(
        _hash_batches, f"{fields}, h0 bigint, s0 bigint, h1 bigint, s1 bigint"
    )


def exact_groups(docs: DataFrame, chunk: int = CHUNK, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (largest doc_id with an equal text), group_size, kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Equal fingerprints only propose a group:
    each member's text is compared with the text of the group's largest doc_id, chunk against chunk, and those that differ
    are grouped again among themselves. Of rows with the same doc_id and an equal text each counts in group_size and one is
    kept; a null doc_id ranks below all others. Other columns are not read. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, chunk, digest=digest), "prints")
    groups = prints.groupBy(*PRINT).agg(F.count("*").alias("n"), *_leader()).filter("n > 1")
    distinct = prints.select("_id", "_x", *PRINT).distinct()
    members = materialise(distinct.join(materialise(groups, "print-groups"), PRINT), "print-members")
    chunks = F.posexplode(chunks_of(F.col("_t"), chunk)).alias("k", "c")
    # Members grow with the data, so they are merged at every size and never broadcast.
    texts = keyed(docs).join(members.hint("merge"), ["_id", "_x"]).select(*members.columns, chunks)
    texts = materialise(texts.dropDuplicates(["_id", "_x", "k"]), "group-texts")
    done, rest = [], texts
    while True:
        compared = materialise(_compare(rest), "compared")
        done.append(compared.filter("same").select("_id", "_x", *PRINT, *LEAD))
        odd = compared.filter(~F.col("same")).select("_id", "_x", *PRINT)
        if odd.isEmpty():
            break
        again = odd.groupBy(*PRINT).agg(F.count("*").alias("n"), *_leader())
        rest = texts.drop(*LEAD, "n").join(odd.join(again, PRINT), ["_id", "_x", *PRINT])
    matched = reduce(DataFrame.unionByName, done)
    named = prints.join(matched, ["_id", "_x", *PRINT], "left")
    named = named.withColumns({"keep": F.coalesce("lead", "_id"), "keep_x": F.coalesce("lead_x", "_x")})
    named = materialise(named.drop(*LEAD), "named")
    key = [*PRINT, "keep", "keep_x"]
    sizes = named.groupBy(*key).agg(
        F.count("*").alias("group_size"), F.min(F.when(F.col("_id") == F.col("keep"), F.col("row"))).alias("_kept_row")
    )
    sizes = materialise(sizes.filter("group_size > 1"), "group-sizes")
    kept = (F.col("_id") == F.col("keep")) & F.coalesce(F.col("row") == F.col("_kept_row"), F.lit(True))
    return named.join(sizes, key, "left").select(
        F.nullif("_id", F.lit(NO_ID)).alias("doc_id"),
        F.nullif("keep", F.lit(NO_ID)).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        kept.alias("kept"),
        *(["text_sha256"] if digest else []),
        "_id",
        "_x",
    )


LEAD = ["lead", "lead_x"]


def _leader() -> list[Column]:
    """The largest doc_id of a group, and which of its texts; rows of one doc_id may hold different texts."""
    return [F.max("_id").alias("lead"), F.max_by("_x", "_id").alias("lead_x")]


def _compare(texts: DataFrame) -> DataFrame:
    """Whether each member's text equals its leader's: an equi-join of chunks, members of a large group dealt to salts.

    The leader's chunks are repeated once for each BUCKET_ROWS members, so the repeats are few and no task gets more.
    """
    salts = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    leaders = texts.filter((F.col("_id") == F.col("lead")) & (F.col("_x") == F.col("lead_x"))).select(
        *PRINT, *LEAD, "k", F.col("c").alias("lead_c"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    key = [*PRINT, *LEAD, "k", "salt"]
    members = texts.withColumn("salt", F.pmod(F.xxhash64("_id", "_x"), salts).cast("int"))
    met = members.join(leaders, key, "left")
    same = F.bool_and(F.col("c").eqNullSafe(F.col("lead_c")))
    return met.groupBy("_id", "_x", *PRINT, *LEAD).agg(same.alias("same"))


def without_copies(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    kept = exact_groups(docs, chunk).filter("kept").select("_id", "_x")
    marked = docs.select(as_row(docs), *row_key(docs, normalised(docs["text"])))
    return marked.join(kept, ["_id", "_x"]).dropDuplicates(["_id", "_x"]).select("_row.*")
