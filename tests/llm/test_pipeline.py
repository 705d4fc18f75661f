"""The corpus pipeline, stage by stage and as a whole, against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rnd, n):
    return " ".join(f"{rnd.choice(['alpha', 'beta', 'gamma', 'delta'])}{rnd.randint(0, 60)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    bases = [sentence(rnd, n) for n in (40, 90, 300)]
    texts = [None, "", "too short", "again and again " * 30, *bases, bases[0].upper(), bases[0]]
    for base in bases:
        for _ in range(4):
            words = base.split()
            words[rnd.randrange(len(words))] = "omega"
            texts.append(" ".join(words))
    texts += [sentence(rnd, rnd.randint(10, 900)) for _ in range(25)] + [sentence(rnd, 2500)]
    return [(i, t, "en", "a" if i % 3 else None) for i, t in enumerate(texts)] + [(5, bases[1], "en", "a"), (None, sentence(rnd, 30), None, "b")]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def good(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        covered |= set(range(i, i + 8)) if counts[run] > 1 else set()
    return len(words) >= 20 and 100 * len(covered) <= 30 * len(words)


def rank(row):
    return -(2**63) if row[0] is None else row[0]


def without_copies(rows):
    best = {}
    for row in rows:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1] or "")
        best[key] = max(best.get(key, row), row, key=rank)
    return list(best.values())


def without_near(rows):
    sets = []
    for row in rows:
        words = (row[1] or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    heads = {}
    for row, g in zip(rows, group, strict=True):
        heads[g] = max(heads.get(g, row), row, key=rank)
    return list(heads.values())


def test_stages(spark, rows, sf_dir, tmp_path):
    want = {"quality_rules": [r for r in rows if good(r[1])]}
    want["exact_dedup"] = without_copies(want["quality_rules"])
    want["ngram_join"] = want["mixing"] = without_near(want["exact_dedup"])
    assert len(rows) > len(want["quality_rules"]) > len(want["exact_dedup"]) > len(want["ngram_join"]) > 20
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert Counter(tuple(r)[:4] for r in docs.collect()) == Counter(want[name]), name
    tool, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for doc_id, text, *_ in want["mixing"]:
        ids = [*tool.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            pieces[(doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    name, stage = corpus_pipeline.STAGES[-1]
    shape = ("doc_id", "piece", "start", "length", "ids_crc32")
    for done in (stage(spark, docs, sf_dir), corpus_pipeline.run(spark, sf_dir)):
        got = done.collect()
        assert Counter(tuple(r[c] for c in shape) for r in got) == pieces
        assert len({r.sequence_id for r in got}) >= -(-sum(r.length for r in got) // 2048)


def weighted(spark, tmp_path, texts_of, n):
    """A folder of documents whose sources have texts of their own, every one unlike the others."""
    rnd = random.Random(4)
    rows = []
    for source, (share, length) in texts_of.items():
        for _ in range(round(share * n)):
            rows.append((len(rows), sentence(rnd, length) + f" end{len(rows)}", "en", source))
    frame = spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA)
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {r[0]: r[3] for r in rows}


def test_the_mixture_shows_in_the_sequences(spark, tmp_path, monkeypatch):
    """Sequences up to any number hold the sources by their weights; without the mixing stage they would follow doc_id."""
    monkeypatch.setattr(corpus_pipeline, "MIX_BLOCK", 4096)
    monkeypatch.setattr(corpus_pipeline.packing, "STRETCH_ROWS", 60)
    sources = weighted(spark, tmp_path, {"a": (0.7, 120), "b": (0.2, 120), "c": (0.1, 120)}, 900)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    weights = {r["source"]: r["parts"] for r in corpus_pipeline.mixing.damped_weights(docs, corpus_pipeline.MIX_PARTS).collect()}
    stages = dict(corpus_pipeline.STAGES)
    stages["mixing"](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    got = stages["best_fit_packing"](spark, mixed, str(tmp_path)).collect()
    ends = max(r["sequence_id"] for r in got) + 1
    assert {r["sequence_id"] for r in got} == set(range(ends))
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048 and Counter(r["doc_id"] for r in got) == Counter(sources.keys())
    # No source has run out before half of the mixture: c holds 10 % of the bytes and wants 18 %.
    for share in (0.1, 0.2, 0.3, 0.4):
        part = Counter()
        for r in got:
            if r["sequence_id"] < share * ends:
                part[sources[r["doc_id"]]] += r["length"]
        for source, parts in weights.items():
            assert abs(part[source] / sum(part.values()) - parts / sum(weights.values())) < 0.1, (share, part)


def test_mixed_files_hold_the_order(spark, tmp_path, monkeypatch):
    sources = weighted(spark, tmp_path, {"a": (0.5, 30), "b": (0.5, 60)}, 200)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    weights = corpus_pipeline.mixing.damped_weights(docs, 100)
    corpus_pipeline.mixing.mixed(docs, weights, 2048).write.parquet(f"{tmp_path}/mixed")
    placed = corpus_pipeline.mixing.stored_place(spark.read.parquet(f"{tmp_path}/mixed"), "at").orderBy("at").collect()
    want = corpus_pipeline.mixing.mix(docs, weights, 2048).orderBy("slot", "place").collect()
    assert [r["doc_id"] for r in placed] == [r["_id"] for r in want] and len(placed) == len(sources)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
