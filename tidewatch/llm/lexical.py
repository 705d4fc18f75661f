"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are tokenised once into rows of (term, occurrences), restricted to the terms of a block of queries; corpus counts
come from these rows. Each task then holds a bounded shard of documents, puts the postings of every term in order of
impact, and runs the algorithm for each query:

* sorted access takes the next positions of all lists of the query, in parallel;
* each document met gets direct accesses to all lists, which give its whole score and its positions there;
* the best position of a list is the end of the stretch of positions, from the first on, that either kind of access has
  seen. A document not seen yet stands behind it in every list, so the impacts there bound its score;
* the search ends when that bound is strictly below the k-th best score, so ties are never cut off.

The k best of a task are carried from shard to shard, and the tasks' k best meet in one window per query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import NO_ID
from tidewatch.session import materialise

#: Terms of the queries that are searched in one pass; more queries take more passes.
BLOCK_TERMS = 200_000
#: Postings and documents of a shard, at least; a batch of rows more at most.
SHARD_POSTINGS = 2_000_000
SHARD_DOCS = 1 << 16
#: Positions of each list taken by the first round of sorted accesses; each round takes twice as many as the last.
FIRST_ROUND = 32
#: Bytes of a text that are cut into terms at once.
SPAN = 1 << 22

#: Bytes of terms stay, A-Z as a-z; all others separate terms. Every byte of a character beyond ASCII is one of a term.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))

FORWARD = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
HITS = "query int, item_id bigint, doc_id bigint, score bigint"


def term_counts(text: str | None) -> Counter[bytes]:
    """Terms of a whole text and how often each occurs, a stretch of the text at a time."""
    if not text:
        return Counter()
    data = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    if len(data) <= SPAN:
        return Counter(data.split())
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SPAN)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), and the vocabulary's terms in it, ascending, with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256)
                lengths, terms, tfs, ends = [], [], [], [0]
                for value in rows.column(1):
                    found = term_counts(value.as_py())
                    lengths.append(sum(found.values()))
                    known = sorted((vocabulary[term], tf) for term, tf in found.items() if term in vocabulary)
                    terms.extend(term for term, _ in known)
                    tfs.extend(tf for _, tf in known)
                    ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("_text")).mapInArrow(run, FORWARD)


class Shard:
    """Impact lists of a few documents, for sorted and direct access."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        """Postings are given by document, then term."""
        self.ids, self.terms, self.impact = ids, terms, impact
        self.keys = doc * terms + term
        order = np.lexsort((-impact, term))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(terms + 1))
        self.position = np.empty(len(doc), np.int64)
        self.position[order] = np.arange(len(doc)) - self.starts[term[order]]

    def direct(self, docs: np.ndarray, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the given documents, which hold the term, with its impact and their positions in its list."""
        key = docs * self.terms + term
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        at = at[hit]
        return hit, self.impact[at], self.position[at]


Best = tuple[np.ndarray, np.ndarray]
NONE: Best = (np.empty(0, np.int64), np.empty(0, np.int64))


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """The k highest scores above 0, equal ones by ascending id."""
    order = np.lexsort((ids, -score))[:k]
    order = order[score[order] > 0]
    return score[order], ids[order]


def best_positions(shard: Shard, query: dict[int, int], k: int, best: Best = NONE) -> tuple[Best, int]:
    """The k best of ``best`` and the shard for a query (term to multiplicity); also how many documents were scored."""
    lists = [(t, int(shard.starts[t]), int(shard.starts[t + 1]), times) for t, times in query.items() if shard.starts[t] < shard.starts[t + 1]]
    seen = [np.zeros(end - start, bool) for _, start, end, _ in lists]
    best_at = [0] * len(lists)  # positions before it have all been seen
    met = np.zeros(len(shard.ids), bool)
    depth, step = 0, FIRST_ROUND
    while lists:
        taken = [shard.list_doc[start + depth : min(end, start + depth + step)] for _, start, end, _ in lists]
        new = np.unique(np.concatenate(taken))
        new = new[~met[new]]
        met[new] = True
        score = np.zeros(len(new), np.int64)
        for (term, _, _, times), mark in zip(lists, seen, strict=True):
            hit, impact, position = shard.direct(new, term)
            score[hit] += times * impact
            mark[position] = True
        best = best_of(np.concatenate([best[0], score]), np.concatenate([best[1], shard.ids[new]]), k)
        bound = 0
        for i, ((_, start, end, times), mark) in enumerate(zip(lists, seen, strict=True)):
            gap = np.flatnonzero(~mark[best_at[i] :])
            best_at[i] = best_at[i] + int(gap[0]) if len(gap) else end - start
            if best_at[i] < end - start:
                bound += times * int(shard.list_impact[start + best_at[i]])
        if not bound or (len(best[0]) == k and bound < best[0][-1]):
            break
        depth, step = depth + step, 2 * step
    return best, int(met.sum())


def weights(df: dict[int, int], with_terms: int) -> dict[int, int]:
    """Whole weight of each term that occurs."""
    return {term: math.floor(1000 * math.log((2 * with_terms + 2) / (2 * n + 1))) for term, n in df.items()}


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """The k best documents of each item, by items (query, item_id, terms, counts) that fit one pass."""
    vocabulary: dict[bytes, int] = {}
    queries = [(q, item, {vocabulary.setdefault(bytes(t), len(vocabulary)): c for t, c in zip(terms, counts, strict=True)}) for q, item, terms, counts in items]
    forward = materialise(forward_index(docs, vocabulary), "forward-index")
    with_terms, all_terms = forward.agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    weight = np.zeros(len(vocabulary), np.int64)
    for term, w in weights({r["term"]: r["df"] for r in found}, with_terms).items():
        weight[term] = w

    def shard_of(batches: list[pa.RecordBatch]) -> Shard:
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids = rows.column("doc_id").fill_null(NO_ID).to_numpy()
        terms = rows.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
        term = terms.flatten().to_numpy().astype(np.int64)
        tf = rows.column("tfs").combine_chunks().flatten().to_numpy()
        size = 100 - 25 + (25 * rows.column("n").to_numpy() * with_terms) // max(all_terms, 1)
        return Shard(ids, doc, term, weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * size[doc])), len(weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [NONE] * len(queries)
        held: list[pa.RecordBatch] = []

        def search() -> None:
            shard = shard_of(held)
            held.clear()
            if len(shard.keys):
                for i, (_, _, query) in enumerate(queries):
                    best[i], _ = best_positions(shard, query, k, best[i])

        postings = n_docs = 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column(2).flatten())
            n_docs += batch.num_rows
            if postings >= SHARD_POSTINGS or n_docs >= SHARD_DOCS:
                search()
                postings = n_docs = 0
        if held:
            search()
        for (q, item, _), (score, ids) in zip(queries, best, strict=True):
            if len(ids):
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * n, pa.int32()), pa.array([item] * n, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(score, pa.int64())],
                    ["query", "item_id", "doc_id", "score"],
                )

    hits = forward.mapInArrow(run, HITS)
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def _items(queries: DataFrame) -> DataFrame:
    """(row, item_id, terms, counts, n): the distinct terms of each query row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64())), pa.array([len(c) for c in found], pa.int64())],
                ["row", "item_id", "terms", "counts", "n"],
            )

    rows = queries.select(F.monotonically_increasing_id().alias("row"), queries["item_id"].cast("bigint").alias("item_id"), queries["text"].alias("_text"))
    return rows.mapInArrow(run, "row bigint, item_id bigint, terms array<binary>, counts array<bigint>, n bigint").filter("n > 0")


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` highest-scoring documents of every query row: item_id, rank from 1, doc_id, score.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. ``docs`` has doc_id and text, ``queries``
    item_id and text; other columns are not read. A term that a query repeats counts as often. Scores are above 0, equal
    ones are ranked by ascending doc_id, a null doc_id first. Rows of one doc_id are documents of their own, and so are
    query rows of one item_id. Null and empty texts have no terms: such documents are never found, such queries
    find nothing. Empty tables give no rows. A long text is counted a stretch at a time.

    Queries are dealt to blocks of about ``block_terms`` distinct terms; only a block's terms and their counts are sent to
    tasks, and each block reads the documents once.
    """
    items = materialise(_items(queries), "queries")
    terms = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-terms // block_terms))
    found = None
    for b in range(blocks):
        dealt = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        block = [(q, r["item_id"], r["terms"], r["counts"]) for q, r in enumerate(dealt.orderBy("row").collect())]
        hits = _search_block(docs, block, k).select("item_id", "rank", "doc_id", "score")
        found = hits if found is None else found.unionByName(hits)
    return found
