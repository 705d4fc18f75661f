"""Toxicity by subwords: the arithmetic against a plain version, learning on planted insults, odd rows."""

import random

import numpy as np
import pytest

from tidewatch.llm import toxicity

DOCS = "doc_id bigint, text string, label int, score double, h int"
INSULTS = ["blockhead", "numbskull", "worthless", "dimwit"]


def plain_subwords(text):
    words = "".join(" " if c <= " " or c in toxicity._ENDS else c for c in text.lower()).split()
    return [[f" {w} "[i : i + n] for n in range(toxicity.GRAMS[0], toxicity.GRAMS[1] + 1) for i in range(len(w) + 3 - n)] for w in words]


def bucket(gram):
    total = sum(ord(c) * pow(0x100000001B3, i, 2**64) for i, c in enumerate(gram)) + len(gram)
    return (total * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BUCKET_BITS)


@pytest.mark.parametrize("text", ["", "a", "One two,three", "  É漢字 x\t\n(st*pid) I'm ", "😀 ok", "x" * 40])
def test_subwords(text):
    number, buckets, words = toxicity.subwords(toxicity.code_points(text))
    want = plain_subwords(text)
    assert words == len(want)
    got = [sorted(buckets[number == k].tolist()) for k in range(words)]
    assert got == [sorted(bucket(g) for g in grams) for grams in want]


def plain_odds(model, text):
    words = [np.mean([model.shares[bucket(g)] for g in grams]) for grams in plain_subwords(text)]
    if not words:
        return model.bias
    n = -(-len(words) // toxicity.STRETCH)
    parts = [[w for i, w in enumerate(words) if i * n // len(words) == k] for k in range(n)]
    return model.bias + max(np.mean(p) for p in parts)


def test_odds_of_the_most_toxic_stretch(monkeypatch):
    model = toxicity.Model(np.random.default_rng(1).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32), -0.5)
    rnd = random.Random(2)
    for n in (0, 1, 11, 12, 13, 100, 700):
        text = " ".join("".join(rnd.choices("abcé", k=rnd.randint(1, 9))) for _ in range(n))
        assert abs(toxicity.log_odds(model, text) - plain_odds(model, text)) < 1e-4
    assert toxicity.log_odds(model, None) == -0.5
    whole = toxicity.log_odds(model, "word " * 50)
    monkeypatch.setattr(toxicity, "SPAN", 64)
    assert abs(toxicity.log_odds(model, "word " * 50) - whole) < 1e-6
    assert np.isfinite(toxicity.log_odds(model, "y" * 1000))


def clean(rnd, n):
    return " ".join("".join(rnd.choices(["ta", "re", "mi", "so", "la", "ne", "vo"], k=rnd.randint(1, 3))) for _ in range(n))


def toxic(rnd, n, pool=INSULTS):
    words = clean(rnd, n).split()
    words[rnd.randrange(n)] = rnd.choice(pool)
    return " ".join(words)


def test_learning(spark):
    rnd = random.Random(8)
    texts = [(i, toxic(rnd, rnd.randint(5, 120)) if i % 4 == 0 else clean(rnd, rnd.randint(5, 120)), int(i % 4 == 0)) for i in range(900)]
    texts += [(10_000 + i, "copied text " * 5, 0) for i in range(50)] + [(20_000, None, 1), (None, "blockhead", 0), (20_001, "blockhead " * 3000, 0)]
    docs = spark.createDataFrame([(i, t, 0, 0.0, 0) for i, t, _ in texts], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(30_000, 1), (1, None), (2, 7)], "doc_id bigint, label int")
    model = toxicity.learn(docs, labels)
    fresh = random.Random(77)
    asked = [(i, toxic(fresh, 60), 1) for i in range(60)] + [(100 + i, clean(fresh, 60), 0) for i in range(60)]
    asked += [(200 + i, toxic(fresh, 40, ["blockheads", "numbskul", "worthles", "dimwits", "nümbskull"]), 1) for i in range(60)]
    long_text = clean(fresh, 4000) + " you blockhead " + clean(fresh, 4000)
    asked += [(300, long_text, 1), (301, clean(fresh, 8000), 0)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(i, t, 0, 0.0, 0) for i, t, _ in asked], DOCS), model, ["doc_id"]).collect()}
    hit = {kind: np.mean([got[i] >= 0.5 for i in ids]) for kind, ids in (("known", range(60)), ("clean", range(100, 160)), ("misspelt", range(200, 260)))}
    assert hit["known"] >= 0.95 and hit["clean"] <= 0.05 and hit["misspelt"] >= 0.7, hit
    assert got[300] >= 0.5 > got[301]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1, 0.5, 1), (1, "", 1, 0.5, 1), (2, " .,\n", 1, 0.5, 1), (3, "same", 1, 0.5, 1), (3, "same", 1, 0.5, 1)], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, label int")
    nothing = toxicity.learn(docs, labels)
    assert [r["score"] for r in toxicity.score(docs, nothing, ["doc_id"]).collect()] == [0.5] * 5
    one = toxicity.learn(docs, spark.createDataFrame([(3, 1)], "doc_id bigint, label int"))
    assert all(r["score"] > 0.99 for r in toxicity.score(docs, one, ["doc_id", "label"]).collect())
    assert toxicity.score(docs.limit(0), nothing, ["doc_id"]).collect() == []
    model = toxicity.train(["a b", "c d"], [0, 1], [1.0, 1.0])
    assert toxicity.chance(toxicity.log_odds(model, "c d")) > toxicity.chance(toxicity.log_odds(model, "a b"))
    assert 0 <= toxicity.chance(1e9) <= 1 and 0 <= toxicity.chance(-1e9) <= 1
