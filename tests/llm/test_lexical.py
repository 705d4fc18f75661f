"""Ranked lexical search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, n bigint, terms string, score string"
ITEMS = "item_id bigint, text string, row int, query int"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k):
    """(item row, doc rank key): every document scored for every item."""
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        query = Counter(terms(text))
        scored = []
        for doc_id, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(total, 1)
            score = 0
            for t, times in query.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, doc_id, -score))
    return sorted(out, key=repr)


def run(spark, docs, items, k, parts=3, **more):
    frame = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], DOCS).repartition(parts)
    queries = spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS)
    rows = lexical.lexical_search(frame, queries, k, **more).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=repr)


def corpus(seed, n):
    rnd = random.Random(seed)
    pool = [f"w{i}" for i in range(120)] + ["Éa", "ÜB", "x_y", "don't"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    docs = [(i, " ".join(rnd.choices(pool, weights, k=rnd.choice([1, 5, 30, 300])))) for i in range(n)]
    items = [(i, " ".join(rnd.choices(pool, weights, k=rnd.choice([1, 3, 12])))) for i in range(12)]
    return docs, items


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_ROUND", 2)


@pytest.mark.parametrize("k", [1, 5, 20])
def test_search(spark, k):
    docs, items = corpus(3, 400)
    assert run(spark, docs, items, k) == brute_force(docs, items, k)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    docs, items = corpus(4, 60)
    docs += [(None, "w1 w2"), (None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2"), (900, None), (901, ""), (902, " .,;_ "), (5, "w1 w2"), (903, "w3 " * 60_000 + "rare")]
    items += [(50, None), (51, ""), (52, "--"), (1, "w1"), (None, "w2 W2 w2"), (53, "rare"), (54, "absent"), (55, "ÉA éa Éa")]
    assert run(spark, docs, items, 4) == brute_force(docs, items, 4)


def test_long_texts_are_counted_by_stretches(monkeypatch):
    monkeypatch.setattr(lexical, "SPAN", 50)
    text = "Alpha, béta-GAMMA " * 40 + "x" * 500
    assert lexical.term_counts(text) == Counter(t.encode() for t in terms(text))


def test_queries_in_blocks(spark):
    docs, items = corpus(5, 80)
    assert run(spark, docs, items, 6, block_terms=15) == brute_force(docs, items, 6)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "w1")], 3) == []
    assert run(spark, [(1, "w1")], [], 3) == []


def shard(seed, n_docs, n_terms):
    """A shard whose documents hold each term with a chance that falls with the term's number."""
    rng = np.random.default_rng(seed)
    held = rng.random((n_docs, n_terms)) < 1 / (1 + np.arange(n_terms))
    doc, term = np.nonzero(held)
    impact = (rng.pareto(1.5, len(doc)) * 1000).astype(np.int64) // 7
    table = np.zeros((n_docs, n_terms), np.int64)
    table[doc, term] = impact
    return lexical.Shard(np.arange(n_docs) * 3 % 1009, doc, term, impact, n_terms), table


@pytest.mark.parametrize("seed", range(8))
def test_best_positions_stop_early_and_right(seed, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_ROUND", 2)
    docs, table = shard(seed, 1000, 12)
    query = {2: 1, 5: 3, 11: 1}
    (score, ids), met = lexical.best_positions(docs, query, 5)
    whole = sum(times * table[:, t] for t, times in query.items())
    want = lexical.best_of(whole, docs.ids, 5)
    assert score.tolist() == want[0].tolist() and ids.tolist() == want[1].tolist()
    assert met < (whole > 0).sum()


def test_ties_at_the_last_place_are_searched(monkeypatch):
    """Equal impacts everywhere: the lowest ids win though they stand last in the lists."""
    monkeypatch.setattr(lexical, "FIRST_ROUND", 1)
    n = 50
    doc = np.repeat(np.arange(n), 2)
    docs = lexical.Shard(np.arange(n)[::-1].copy(), doc, np.tile([0, 1], n), np.full(2 * n, 9), 2)
    (score, ids), _ = lexical.best_positions(docs, {0: 1, 1: 1}, 3)
    assert ids.tolist() == [0, 1, 2] and score.tolist() == [18, 18, 18]
