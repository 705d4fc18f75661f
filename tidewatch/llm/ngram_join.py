"""Joining near copies: Jaccard similarity of five-word shingles, with Bayesian pruning of candidates.

Texts with the same words are one class. Classes meet when a band of their MinHash values agrees. A pair's values are then
compared a few at a time, and the pair is dropped once the posterior probability that it reaches the threshold is below a
tolerance; what is left is verified on the whole shingle sets. Pairs are never rows: a bucket of classes that agree in a
band is worked on in cells of bounded size, and a cell gives each class its number of links and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import as_row, row_key
from tidewatch.llm.tokens import map_texts
from tidewatch.session import materialise

WORDS = 5
THRESHOLD = 0.8
#: A pair just at the threshold agrees in none of the bands with a chance of (1 - 0.8^4)^24, about 3 in a million.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Values compared before the posterior is looked at again, and the probability below which a pair is dropped.
STEP = 16
TOLERANCE = 1e-6
#: Classes and shingles of a slice of a bucket; a cell meets two slices.
SLICE_CLASSES, SLICE_SHINGLES = 256, 1 << 20
#: A multiplier of shingle hashes, and the seed of the hash functions.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SEED = 20240229
_DRAW = np.random.RandomState(SEED)
MULTIPLY = _DRAW.randint(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _DRAW.randint(0, 2**63, HASHES, dtype=np.uint64)

SKETCH = "_id bigint, _x bigint, c binary, n int, sig binary"


def shingles(words: list[str]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of WORDS words; a shorter text is one run, one without words has none."""
    if not words:
        return np.empty(0, np.uint64)
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    width = min(WORDS, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * FACTOR + each[k : len(each) - width + 1 + k]
        total ^= total >> np.uint64(29)
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set, 32 bits each."""
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 2048):
        mixed = found[at : at + 2048, None] * MULTIPLY + ADD
        np.minimum(low, mixed.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... values compared: fewest matches with which P(similarity >= threshold) is not below the tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1); its upper tail at t is
    P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def sketches(docs: DataFrame) -> DataFrame:
    """(_id, _x, c, n, sig) per row: class (a 128-bit hash of the words), number of shingles, MinHash values."""

    def sketch(kept: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        classes, counts, values = [], [], []
        for text in texts:
            words = _words_of(text)
            found = shingles(words)
            classes.append(xxhash.xxh3_128_digest(" ".join(words)))
            counts.append(len(found))
            values.append(signature(found).tobytes() if len(found) else b"")
        added = [pa.array(classes, pa.binary()), pa.array(counts, pa.int32()), pa.array(values, pa.binary())]
        return pa.RecordBatch.from_arrays([*kept.columns, *added], ["_id", "_x", "c", "n", "sig"])

    return map_texts(_keyed(docs), ["_id", "_x"], "_t", SKETCH, sketch)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(*row_key(docs, text), text.alias("_t"))


def _bands(classes: DataFrame) -> DataFrame:
    of_band = lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * 4 * ROWS + 1, F.lit(4 * ROWS)))
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), of_band)
    return classes.filter("n > 0").select("c", "n", F.posexplode(keys).alias("band", "key"))


def _cells(classes: DataFrame) -> DataFrame:
    """(c, cells): the cells each class that met another takes part in, with the slice it is in there.

    Buckets with the same classes, usual for lone pairs, are worked on once, in their first band.
    """
    bands = _bands(classes)
    several = bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    members = materialise(bands.join(several, "key"), "bucket-members")
    same = [F.bit_xor(F.xxhash64("c")).alias("f"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("g")]
    buckets = members.groupBy("key").agg(
        F.min("band").alias("band"), F.count("*").alias("m"), F.sum("n").alias("weight"), *same
    )
    first = buckets.groupBy("m", "f", "g").agg(F.min(F.struct("band", "key", "weight")).alias("b"))
    slices = F.greatest(F.ceil(F.col("m") / SLICE_CLASSES), F.ceil(F.col("b.weight") / SLICE_SHINGLES)).cast("int")
    buckets = materialise(first.select("b.band", "b.key", slices.alias("slices")), "buckets")
    dealt = members.drop("band", "n").join(buckets, "key").withColumn("s", F.pmod(F.xxhash64("c", "key"), F.col("slices")).cast("int"))
    return dealt.groupBy("c").agg(F.collect_list(F.struct("key", "band", "s", "slices")).alias("cells"))


def _compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by cell; hold one cell and one batch."""
    fewest, rest = least_matches(), None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rest = rows if rest is None else pa.concat_tables([rest, rows])
        cell = np.stack([rest.column(k).to_numpy() for k in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from _links(rest.slice(a, b - a), fewest)
        rest = rest.slice(cuts[-1]).combine_chunks()
    if rest is not None:
        yield from _links(rest, fewest)


def _links(rows: pa.Table, fewest: list[int]) -> Iterator[pa.RecordBatch]:
    """Links among the classes of a cell: (class, root of its tree, number of links) of every class with a link."""
    count = rows.num_rows
    if count < 2:
        return
    i, j = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
    band = rows.column(3)[0].as_py()
    side = rows.column(4).to_numpy()
    values = np.frombuffer(b"".join(rows.column(6).to_pylist()), "<u4").reshape(count, HASHES)
    bands = values.view("<u8").reshape(count, BANDS, -1)
    sets = [np.frombuffer(x, "<u8") for x in rows.column(7).to_pylist()]
    sizes = np.array([len(s) for s in sets])
    everything, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    ids = [ids[end - n : end] for end, n in zip(ends, sizes, strict=True)]
    mark = np.zeros(len(everything), bool)
    links, root = np.zeros(count, np.int64), list(range(count))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(count):
        others = np.arange(a + 1, count) if i == j else np.flatnonzero(side == j) if side[a] == i else None
        if others is None or not len(others):
            continue
        fits = np.minimum(sizes[a], sizes[others]) >= THRESHOLD * np.maximum(sizes[a], sizes[others])
        others = others[fits]
        # A pair that agrees in several bands belongs to the first.
        earlier = (bands[others, :band] == bands[a, :band]).all(axis=2).any(axis=1)
        others = others[~earlier]
        matches = np.zeros(len(others), np.int64)
        for k, least in enumerate(fewest):
            part = slice(k * STEP, (k + 1) * STEP)
            matches += (values[others, part] == values[a, part]).sum(axis=1)
            alive = matches >= least
            others, matches = others[alive], matches[alive]
        if not len(others):
            continue
        mark[ids[a]] = True
        for b in others.tolist():
            shared = int(np.count_nonzero(mark[ids[b]]))
            # In whole numbers, shared / union >= 4 / 5.
            if 5 * shared >= 4 * (int(sizes[a]) + int(sizes[b]) - shared):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
        mark[ids[a]] = False
    found = np.flatnonzero(links)
    if len(found):
        names = rows.column(5).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[k] for k in found], pa.binary()),
                pa.array([names[top(int(k))] for k in found], pa.binary()),
                pa.array(links[found], pa.int64()),
            ],
            ["c", "r", "links"],
        )


def _with_sets(docs: DataFrame, classes: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per cell and class in it: cell, band, slice, class, MinHash values, shingle set."""
    wanted = cells.join(classes.select("c", "sig", "rep.*"), "c")
    texts = _keyed(docs).join(wanted, ["_id", "_x"]).dropDuplicates(["_id", "_x"])

    def attach(kept: pa.RecordBatch, given: list[str | None]) -> pa.RecordBatch:
        sets = pa.array([shingles(_words_of(text)).tobytes() for text in given], pa.binary())
        return pa.RecordBatch.from_arrays([*kept.columns, sets], ["c", "sig", "cells", "shingles"])

    cell = "array<struct<key:bigint,band:int,s:int,slices:int>>"
    rows = map_texts(texts, ["c", "sig", "cells"], "_t", f"c binary, sig binary, cells {cell}, shingles binary", attach)
    rows = rows.select("c", "sig", "shingles", F.inline("cells"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return rows.select(
        "key", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "band", F.col("s").alias("side"), "c", "sig", "shingles"
    )


def components(edges: DataFrame) -> DataFrame:
    """(c, root): the least node each node is connected to, by alternating large and small stars.

    Each round moves every edge nearer to its least neighbour by plain aggregates and joins, and is written out; rounds grow
    with the logarithm of the longest path.
    """
    edges = materialise(edges.filter(F.col("c") != F.col("r")).select(F.greatest("c", "r").alias("a"), F.least("c", "r").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large-stars")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialise(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-stars")
        changed = not small.exceptAll(edges).isEmpty() or not edges.exceptAll(small).isEmpty()
        edges = small
        if not changed:
            return edges.select(F.col("a").alias("c"), F.col("b").alias("root"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_copies, n_links, group_id, kept.

    Words are what white space separates in the lower-cased text. A class holds the rows with the same words in the same
    order, its id is their largest doc_id and n_copies their number; n_links counts the other classes whose shingle sets have
    a Jaccard similarity of at least 0.8. A group is what links connect, named by its largest doc_id, whose row is kept
    (rows equal in doc_id and text are all marked). Texts without words are one class without links; a null text is
    such a text, a null doc_id ranks below all others. Other columns are not read. An empty table gives no rows.
    """
    drawn = materialise(sketches(docs), "sketches")
    classes = drawn.groupBy("c").agg(
        F.max(F.struct("_id", "_x")).alias("rep"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.count("*").alias("n_copies")
    )
    classes = materialise(classes, "classes")
    cells = materialise(_cells(classes), "cells")
    rows = _with_sets(docs, classes, cells).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialise(rows.mapInArrow(_compare_cells, "c binary, r binary, links bigint"), "links")
    links = found.groupBy("c").agg(F.sum("links").alias("n_links"))
    linked = materialise(links.join(components(found), "c", "left"), "linked")
    named = classes.select("c", "rep", "n_copies").join(linked, "c", "left")
    named = materialise(named.select("c", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "c").alias("root")), "named")
    heads = named.filter("n_links > 0").groupBy("root").agg(F.max("rep").alias("head"))
    placed = named.join(materialise(heads, "heads"), "root", "left").withColumn("head", F.coalesce("head", "rep"))
    placed = materialise(placed.select("c", "rep", "n_copies", "n_links", "head"), "placed")
    here = F.struct("_id", "_x")
    return drawn.select("_id", "_x", "c").join(placed, "c").select(
        F.nullif("_id", F.lit(-(2**63))).alias("doc_id"),
        F.nullif("rep._id", F.lit(-(2**63))).alias("class_id"),
        "n_copies",
        "n_links",
        F.nullif("head._id", F.lit(-(2**63))).alias("group_id"),
        (here == F.col("head")).alias("kept"),
        "_id",
        "_x",
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group, with its own columns."""
    kept = near_groups(docs).filter("kept").select("_id", "_x").distinct()
    rows = docs.select(as_row(docs), *row_key(docs, F.coalesce(docs["text"], F.lit(""))))
    return rows.join(kept, ["_id", "_x"]).dropDuplicates(["_id", "_x"]).select("_row.*")
