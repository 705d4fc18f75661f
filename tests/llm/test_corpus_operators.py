"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import (
    exact_dedup,
    language_id,
    mixing,
    ngram_join,
    packing,
    quality,
    sharding,
    token_counts,
    token_ids,
)
from tidewatch.llm.common import numbered
from tidewatch.llm.tokens import Encoder
from tidewatch.session import materialise, scratch_path

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
# Columns of an input may have any names, those used inside included.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, _id string, key int, row int"


def words(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rnd.randint(0, 40)) for _ in range(n))


def texts():
    rnd = random.Random(5)
    base, long_text = words(rnd, 60), words(rnd, 3000)
    return [
        None, "", None, " \n\t ", "one", "One", "ONE", "Éa", "éa", base, base.upper(), base, base.replace("alpha", "Alpha", 1),
        base + " more", base.rsplit(" ", 2)[0], long_text, long_text + " end", "x" * 30000, "x" * 30000, "%% ## ||" * 9,
        "same line here\n" * 40, "漢字 かな 1 2 3", "a\x1cb c", "tab\there  two\n\nlines <|endoftext|> ",
        *[words(rnd, rnd.randint(1, 80)) for _ in range(20)],
    ]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "a")[i % 4]) for i, t in enumerate(texts())]
    return [*out, out[9], out[9], (None, "nobody", "en", "a"), (None, "nobody", "en", "a"), (3, "other text of three", "en", "b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(*r, len(r[1] or ""), 1, "x", 2, 3) for r in rows]
    return materialise(spark.createDataFrame(data, SCHEMA).repartition(3), "docs")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("chunk", [7, exact_dedup.CHUNK])
def test_exact_groups(docs, rows, chunk):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[lowered(text)].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    got = exact_dedup.exact_groups(docs, chunk, digest=True).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    stays = exact_dedup.without_copies(docs, chunk)
    assert stays.columns == docs.columns
    assert Counter(lowered(r.text) for r in stays.collect()) == Counter(list(groups))


def test_fingerprints_compose(spark, docs):
    hasher = exact_dedup.Hasher(exact_dedup.BASES[0], exact_dedup.PRIMES[0], 16)
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    for cut in (0, 1, 15, 16, 17, 300, 768):
        both = exact_dedup.compose(hasher(data[:cut]), hasher(data[cut:]), hasher.prime)
        assert both == hasher(data)
    plain = 0
    for byte in data.tolist():
        plain = (plain * hasher.base + byte) % hasher.prime
    assert hasher(data)[0] == plain
    small, whole = (exact_dedup.fingerprints(docs, c).drop("row") for c in (5, 1 << 16))
    assert Counter(small.collect()) == Counter(whole.collect())


def test_colliding_fingerprints_are_told_apart(spark, docs, rows, monkeypatch):
    real = exact_dedup.fingerprints

    def weak(*args, **options):
        return real(*args, **options).withColumns({"f0": F.lit(1).cast("bigint"), "f1": F.lit(2).cast("bigint")})

    monkeypatch.setattr(exact_dedup, "fingerprints", weak)
    got = exact_dedup.exact_groups(docs.filter("length(text) < 10"), 4)
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        if text is not None and len(text) < 10:
            groups[lowered(text)].append(doc_id)
    assert Counter((r.doc_id, r.group_size) for r in got.collect()) == Counter((i, len(g)) for g in groups.values() for i in g)


def test_colliding_texts_of_one_doc_id_are_told_apart(spark, monkeypatch):
    """Two texts under one id and copies of both under others, all with one fingerprint: four groups of their own texts."""
    real = exact_dedup.fingerprints

    def weak(*args, **options):
        return real(*args, **options).withColumns({"f0": F.lit(1).cast("bigint"), "f1": F.lit(2).cast("bigint")})

    monkeypatch.setattr(exact_dedup, "fingerprints", weak)
    data = [(7, "text a"), (7, "text b"), (3, "text a"), (4, "text b"), (9, "text c"), (7, "text b"), (5, "x" * 9 + "y" * 9), (5, "y" * 9 + "x" * 9), (6, "x" * 9 + "y" * 9)]
    frame = spark.createDataFrame([(i, t, "en", "a", 1, 1, "x", 2, 3) for i, t in data], SCHEMA).repartition(3)
    want = Counter()
    for i, t in data:
        group = [j for j, u in data if u == t]
        want[(i, max(group), len(group))] += 1
    got = exact_dedup.exact_groups(frame, 4).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    kept = exact_dedup.without_copies(frame, 4).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter({max((p for p in data if p[1] == t), key=lambda p: p[0]): 1 for _, t in data})


def test_chunks_of_long_texts_are_dealt(spark):
    """A text of many chunks is hashed by several tasks."""
    frame = spark.createDataFrame([(1, "abcd" * 500, "en", "a", 1, 1, "x", 2, 3)], SCHEMA)
    plan = exact_dedup.fingerprints(frame, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [row" in plan


def sets_of(text):
    found = (text or "").lower().split()
    return found, {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def plain_schedule(weights):
    """Earliest deadline first with a counter per source."""
    period, given, slots = sum(weights.values()), dict.fromkeys(sorted(weights), 0), defaultdict(list)
    for t in range(period):
        ready = [(-(-(k + 1) * period // weights[s]), s) for s, k in given.items() if k * period // weights[s] <= t]
        if ready:
            _, s = min(ready)
            given[s] += 1
            slots[s].append(t)
    return dict(slots)


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 3, "c": 2, "": 5}, {f"s{i}": 1 + i % 4 for i in range(60)}, {f"s{i:02d}": 1 for i in range(40)}])
def test_schedule(spark, weights, monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT", 7)
    got = mixing.schedule(spark.createDataFrame(list(weights.items()), "source string, parts bigint")).collect()
    assert {r["source"]: r["slots"] for r in got} == plain_schedule(weights)
    assert all(r["parts"] == weights[r["source"]] and r["period"] == sum(weights.values()) for r in got)


def test_schedule_of_very_many_sources(spark):
    weights = spark.range(20_000).select(F.format_string("s%06d", "id").alias("source"), (1 + F.col("id") % 3).alias("parts"))
    got = mixing.schedule(weights).agg(F.count("*"), F.sum(F.size("slots")), F.max("period")).first()
    assert tuple(got) == (20_000, 20_000 + 19_999, 39_999)


@pytest.mark.parametrize("slice_classes", [2, ngram_join.SLICE_CLASSES])
def test_near_groups(spark, slice_classes, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE_CLASSES", slice_classes)
    rnd = random.Random(9)
    bases = [words(rnd, n) for n in (30, 60, 200, 4)]
    made = [None, "", " ", "hi", "Hi", None]
    for base in bases:
        for _ in range(14):
            parts = base.split()
            for _ in range(rnd.randint(0, 3)):
                parts[rnd.randrange(len(parts))] = words(rnd, 1)
            made.append(" ".join(parts[: len(parts) - rnd.randint(0, 2)]))
    data = [(i, t) for i, t in enumerate(made)] + [(None, bases[0]), (7, made[7])]
    frame = spark.createDataFrame([(*r, 1, "y") for r in data], "doc_id bigint, text string, c int, sig string").repartition(3)
    classes = defaultdict(list)
    for i, t in data:
        classes[tuple(sets_of(t)[0])].append(-(2**63) if i is None else i)
    sets = {c: sets_of(" ".join(c))[1] for c in classes}
    links = {a: {b for b in classes if a != b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} for a in classes}
    group = {c: {c} for c in classes}
    for a in classes:
        todo = [a]
        while todo:
            for b in links[todo.pop()] - group[a]:
                group[a].add(b)
                todo.append(b)
    ids = lambda i: None if i == -(2**63) else i
    want = Counter()
    for c, members in classes.items():
        head = max(max(classes[b]) for b in group[c])
        for i in members:
            want[(ids(i), ids(max(members)), len(members), len(links[c]), ids(head), i == head)] += 1
    got = ngram_join.near_groups(frame).drop("_id", "_x")
    assert Counter(map(tuple, got.collect())) == want
    stays = ngram_join.without_near_copies(frame)
    assert stays.columns == frame.columns and stays.count() == len({frozenset(g) for g in group.values()})


def test_pruning_keeps_what_can_reach_the_threshold():
    fewest = ngram_join.least_matches(0.8, 1e-6)
    assert fewest == sorted(fewest) and all(0 <= m < 0.8 * n for m, n in zip(fewest, range(16, 97, 16), strict=True))


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(20)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    frame = spark.createDataFrame([(a.to_bytes(2), b.to_bytes(2)) for a, b in edges], "c binary, r binary")
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for a in near:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        if min(seen) != a:
            want[a] = min(seen)
    got = {int.from_bytes(r.c): int.from_bytes(r.root) for r in ngram_join.components(frame).collect()}
    assert got == want


def test_encoder_equals_tokenizer():
    rnd = random.Random(1)
    for path in (WORD, BYTE):
        encode = Encoder(path)
        for alphabet in ("ab Z1é' \t\n  \r.,<|é́\x1d　ßΣ漢\U0001f600 s t", "ab Z1é' sé漢. "):
            given = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
            assert list(encode.encode_all(given)) == [encode.plain(x) for x in given]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_new_words_are_made_of_known_pieces(path, monkeypatch):
    """Plain new words are cut as the tokenizer cuts them; other new ones are still encoded as they are."""
    rng = random.Random(5)
    parts = ["don't", "It'S", "'ll", "we'Re", "ab", "ÀÉß", "çñ", "x1y22", "...", "--a", "$%", "\n", ".\nNext", "ÿz", "~", "|>", "'", "'s'd", "I"]
    odd = ["×", "ÿ÷", "e\u0301", "\u0130x", "\u03a3\u03a3", "\u212a", "\xa0q", "\x7f", "\t", "\u4e2d\u6587", "\xb5", "\u0660", "\U0001f600", "<|endoftext|>"]
    plain = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(30)) for _ in range(300)]
    mixed = [" ".join("".join(rng.choices(parts + odd, k=rng.randint(0, 4))) for _ in range(30)) for _ in range(300)]
    encode = Encoder(path)
    assert list(encode.encode_all([*mixed, None, "", " "])) == [*map(encode.plain, mixed), b"", b"", encode.plain(" ")]
    held = ["a", "ab " * 30, "b" * 90 + " c", " x", "c d"]
    monkeypatch.setattr("tidewatch.llm.tokens.HELD", 60)
    assert list(encode.encode_all(held)) == list(map(encode.plain, held))
    monkeypatch.setattr(Encoder, "_fast", lambda self, text: pytest.fail("a plain word was encoded as a text"))
    known = Encoder(path)
    assert list(known.encode_all(plain)) == list(map(known.plain, plain))



def ids_of(path, text, end):
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    return [*tool.encode(text or "", add_special_tokens=False).ids, end]


def test_queries_encode_special_tokens_as_the_plain_call(spark, tmp_path):
    from tidewatch.llm import queries

    given = ["one <|endoftext|> two", "<|startoftext|>a  b<|endoftext|><|endoftext|>", "a <| b", "plain text", "<|startoftext|>", None]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(given)], "doc_id bigint, text string, source string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    plain = {p: [Tokenizer.from_file(p).encode(t or "", add_special_tokens=False).ids for t in given] for p in (WORD, BYTE)}
    assert plain[BYTE][0] == [505, 220, 50256, 734] and plain[WORD][0] != ids_of(WORD, given[0], 0)[:-1]
    packed = queries.op8_best_fit_packing(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in packed} == {i: (len(x) + 1, crc([*x, 0])) for i, x in enumerate(plain[WORD])}
    stored, start = {r.doc_id: r for r in queries.op9_token_ids(spark, str(tmp_path)).collect()}, 0
    for i, x in enumerate(plain[BYTE]):
        assert tuple(stored[i]) == (i, start, len(x) + 1, crc([*x, 2]))
        start += len(x) + 1
    counts = queries.op10_token_counts(spark, str(tmp_path)).collect()
    assert {r.n_tokens: r.n_docs for r in counts} == Counter(map(len, plain[BYTE]))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_long_texts_are_encoded_whole(monkeypatch):
    from tidewatch.llm import tokens

    monkeypatch.setattr(tokens, "SPAN", 50)
    encode = Encoder(BYTE)
    given = [words(random.Random(i), 90) + "  \n end" * (i % 3) for i in range(10)]
    assert list(encode.encode_all(given)) == [encode.plain(x) for x in given]


def test_packing(docs, rows):
    window = 64
    got = packing.pack_documents(docs, WORD, 0, window).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = ids_of(WORD, t, 0)
        for k in range(0, len(ids), window):
            want[(i, k // window, k, len(ids[k : k + window]), crc(ids[k : k + window]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    rooms = []
    for (_, _, _, length, _), n in sorted(want.items(), key=lambda x: -x[0][3]):
        for _ in range(n):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((window if fit is None else fit) - length)
    assert len(filled) == len(rooms)


def test_token_files(spark, docs, rows):
    folder = scratch_path(spark, "ids")
    files = materialise(token_ids.write_token_files(docs, folder, BYTE, 2), "files")
    got = token_ids.read_token_files(files, folder).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = Counter(), 0
    for i, t, *_ in order:
        ids = ids_of(BYTE, t, 2)
        want[(i, start, len(ids), crc(ids))] += 1
        start += len(ids)
    assert Counter(map(tuple, got)) == want


def test_token_files_are_read_by_as_many_tasks(spark):
    """Every file is read in a task of its own, and nothing is broadcast or joined to what is read."""
    wide = spark.createDataFrame([(i // 40, f"text {i} " * 300, "en", "a", 1, 1, "x", 2, 3) for i in range(400)], SCHEMA)
    folder = scratch_path(spark, "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = materialise(token_ids.write_token_files(wide, folder, BYTE, 2), "files")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 2
    read = token_ids.read_token_files(files, folder)
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() == files.count()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_a_doc_id_of_many_rows_is_cut(spark):
    """Rows without a doc_id go to several files and still come back in order."""
    rows = [(None, f"{i:04d} text " * 50, "en", "a", 1, 1, "x", 2, 3) for i in range(300)]
    folder = scratch_path(spark, "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = materialise(token_ids.write_token_files(spark.createDataFrame(rows, SCHEMA), folder, BYTE, 2), "files")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 2
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_ids.read_token_files(files, folder).collect())
    start = 0
    for (at, n, sum_), row in zip(got, sorted(rows, key=lambda r: r[1]), strict=True):
        ids = ids_of(BYTE, row[1], 2)
        assert (at, n, sum_) == (start, len(ids), crc(ids))
        start += n


@pytest.mark.parametrize("bits", [1, 3, 15, 16, 17, 32])
def test_bits(bits):
    ids = np.random.RandomState(bits).randint(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = token_ids.pack_bits(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (token_ids.unpack_bits(packed, 1001, bits) == ids).all()
    assert token_ids.bits_for(2**bits) == bits


def test_random_access(tmp_path, monkeypatch):
    import pyarrow.fs as pafs

    monkeypatch.setattr(token_ids, "BLOCK", 64)
    given = [np.arange(n, dtype=np.uint32) % 50257 for n in (0, 1, 63, 64, 65, 500, 3)]
    store = pafs.LocalFileSystem()
    with store.open_output_stream(str(tmp_path / "f")) as out:
        writer = token_ids.Writer(out, 16)
        for k, ids in enumerate(given):
            writer.add(k, ids)
        writer.close()
    with store.open_input_file(str(tmp_path / "f")) as source:
        reader = token_ids.Reader(source)
        for k in reversed(range(len(given))):
            assert (reader.document(k) == given[k]).all()


def test_token_counts(docs, rows):
    lengths = defaultdict(list)
    for _, t, _, source in rows:
        lengths[source].append(len(ids_of(BYTE, t, 0)) - 1)
    histogram = token_counts.length_histogram(token_counts.token_lengths(docs, BYTE, ["source"]), ["source"])
    limits = token_counts.limit_table(histogram, ["source"])
    got = {(r.source, r.n_tokens): r for r in limits.collect()}
    assert set(got) == {(s, n) for s, all_ in lengths.items() for n in all_}
    for (source, limit), r in got.items():
        mine = lengths[source]
        assert (r.n_docs, r.docs_longer, r.tokens_longer) == (
            mine.count(limit), sum(n > limit for n in mine), sum(n for n in mine if n > limit)
        )
        assert r.tokens_truncated == sum(min(n, limit) for n in mine) and r.tokens_total == sum(mine)
    for limit in (0, 5, 77, 10**6):
        cut = {r.source: r.tokens_truncated for r in token_counts.at_limit(limits, ["source"], limit).collect()}
        assert cut == {s: sum(min(n, limit) for n in mine) for s, mine in lengths.items()}
    half = {r.source: r.n_tokens for r in token_counts.quantile_lengths(limits, ["source"], 0.5).collect()}
    assert half == {s: sorted(mine)[-(-len(mine) // 2) - 1] for s, mine in lengths.items()}


def test_shards_balance(spark):
    """Shards of the operator itself: differencing leaves them closer than dealing whole groups largest first."""
    rnd = random.Random(9)
    texts_ = ["x" * int(rnd.paretovariate(1.1) * 40) + str(i) for i in range(3000)] + ["copy " * 30] * 200
    frame = spark.createDataFrame([(i, t, "en", "a", 1, 1, "x", 2, 3) for i, t in enumerate(texts_)], SCHEMA).repartition(4)
    sums = Counter()
    for r in sharding.shard_documents(frame, 6).collect():
        sums[r["shard"]] += r["size"]
    assert len(sums) == 6 and sum(sums.values()) == sum(len(t) + 8 for t in texts_)
    loads = [0] * 6
    sizes = Counter(texts_)
    for size in sorted(((len(t) + 8) * n for t, n in sizes.items()), reverse=True):
        loads[loads.index(min(loads))] += size
    assert max(sums.values()) - min(sums.values()) <= max(2, max(loads) - min(loads))


def test_sharding(docs, rows, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 6)
    monkeypatch.setattr(sharding, "FAN", 3)
    got = sharding.shard_documents(docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    slots, places = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        places[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in places.values())


def test_differencing_balances():
    rnd = random.Random(2)
    sizes = [rnd.randint(1, 1000) for _ in range(500)]
    sums, places = sharding.difference([[0, 0, 0, s] for s in sizes])
    totals = [0] * 4
    for size, place in zip(sizes, places, strict=True):
        totals[place[-1]] += size
    assert totals == sums and max(sums) - min(sums) <= 2


def test_mixing(docs, rows, spark):
    weights = spark.createDataFrame([("a", 3), ("b", 2), ("", 1)], "source string, parts bigint")
    got = mixing.mix(docs, weights, 100).collect()
    assert len(got) == len(rows) and Counter(r.source for r in got) == Counter(r[3] or "" for r in rows)
    parts = {"a": 3, "b": 2, "": 1}
    blocks = {(r.source, r.block): r.slot for r in got}
    slots = Counter(blocks.values())
    assert max(slots.values()) == 1
    last = {s: max(b for t, b in blocks if t == s) for s in parts}
    for t in range(max(slots) + 2):
        for s, w in parts.items():
            # A long row may make a source skip block numbers; their slots stay empty and count as given.
            given = sum(slot < t for slot in (mixing_slot(w, 6, k, s) for k in range(last[s] + 1)))
            if given <= last[s]:
                assert abs(given - t * w / 6) < 1
    ordered = mixing.mixed(docs, weights, 100)
    assert ordered.columns == docs.columns
    assert Counter(map(str, ordered.collect())) >= Counter({str(r) for r in docs.distinct().collect()})


PERIOD = {}


def mixing_slot(weight, period, block, source):
    """Earliest deadline first, slot by slot."""
    if not PERIOD:
        parts = {"": 1, "a": 3, "b": 2}
        given = dict.fromkeys(parts, 0)
        for t in range(6):
            ready = [(-(-(given[s] + 1) * 6 // p), s) for s, p in parts.items() if given[s] * 6 // p <= t]
            s = min(ready)[1]
            PERIOD[(s, given[s])] = t
            given[s] += 1
    return block // weight * period + PERIOD[(source, block % weight)]


def test_schedule_deviates_less_than_a_block(spark):
    rnd = random.Random(4)
    weights = [(f"s{k:02d}", rnd.randint(1, 40)) for k in range(12)]
    plan = mixing.schedule(spark.createDataFrame(weights, "source string, parts bigint")).collect()
    period = sum(w for _, w in weights)
    assert sorted(t for r in plan for t in r.slots) == list(range(period))
    for r in plan:
        for t in range(period + 1):
            assert abs(sum(slot < t for slot in r.slots) - t * r.parts / period) < 1


def plain_measures(text):
    found = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return (
        len(found), sum(map(len, found)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)
    )


def test_quality(docs, rows, spark):
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(30, 0), (31, None), (None, 1), (5, 1), (6, 0)], "doc_id bigint, quality int")
    got = quality.quality_verdicts(docs, labels).collect()
    want = Counter()
    for i, t, *_ in rows:
        n, chars, symbols, lines, repeated = plain_measures(t)
        want[(i, n, chars, symbols, lines, repeated, n < 20 or 100 * repeated > 30 * n)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels for any guarantee
    stays = quality.without_bad(docs, labels)
    assert stays.columns == docs.columns and stays.count() == sum(r.kept for r in got)


def test_repeated_words(spark):
    rnd = random.Random(8)
    given = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    split = F.filter(F.split("t", quality.GAP), lambda w: w != "")
    got = {r.i: r.n for r in frame.select("i", quality.repeated_words(split).alias("n")).collect()}
    assert got == {i: plain_measures(t)[4] for i, t in enumerate(given)}


def test_cutoffs_hold_their_bound(spark):
    from math import comb

    rule = quality.Rule("r", "n_symbols", "word_chars", (0.1, 0.2, 0.3))
    data = [("en", 0, 100)] * 990 + [("en", 15, 100)] * 8 + [("en", 25, 100)] * 2 + [("de", 0, 100)] * 20
    good = spark.createDataFrame(data, "stratum string, n_symbols long, word_chars long")
    got = {r.stratum: r.r for r in quality.controlled_cutoffs(good, (rule,), 0.01, 0.05).collect()}
    level, n = 0.05 / 6, 1000
    bound = lambda k: sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) <= level
    assert not bound(10) and bound(2)
    assert got == {"en": 0.2, "de": None}
    cdf = spark.range(1).select(quality.binomial_cdf(F.lit(7).cast("bigint"), F.lit(n).cast("bigint"), 0.01).alias("p")).first().p
    assert abs(cdf - sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(8))) < 1e-9


def test_cutoffs_reject_what_bad_labels_have_in_common(spark):
    plain, heavy = " ".join(f"word{i}" for i in range(30)), " ".join(f"word{i}##" for i in range(30))
    capital = " ".join(f"WORD{i}" for i in range(30))
    data = [(i, plain, lang) for lang, n, at in (("de", 500, 0), ("en", 900, 1000), ("fr", 300, 2000)) for i in range(at, at + n)]
    good = len(data)
    # One good text of de is all capitals: steps of that rule would stop the path there if they came first.
    data[0] = (0, capital, "de")
    data += [(3000 + 100 * k + i, heavy, lang) for k, lang in enumerate(("de", "en", "fr")) for i in range(60)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    # Of the bad texts only the first half is labelled.
    labels = [(i, 1) for i, *_ in data[:good]] + [(i, 0) for i, *_ in data[good:] if i % 100 < 30] + [(3099, None)]
    got = quality.quality_verdicts(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {r.doc_id for r in got if not r.kept} == {i for i, _, lang in data[good:] if lang != "fr"}  # 300 good labels are too few


def test_language(spark, docs, nothing):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    learned = language_id.learn(frame.filter(~held))
    assert set(learned) == {"en", "de", "fr", "es"} and all(len(d) <= language_id.DICTIONARY_BYTES for d in learned.values())
    done = language_id.identify(frame.filter(held), learned, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in done) >= 0.95 * len(done)
    odd = {r.doc_id: r for r in language_id.identify(docs, learned, ["doc_id"]).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[19].lang_pred == "und" and odd[0].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values())
    nobody = language_id.identify(docs, language_id.learn(nothing), ["doc_id"])
    assert {r.lang_pred for r in nobody.collect()} == {"und"}


def test_every_language_gives_to_its_dictionary(spark):
    copied = spark.createDataFrame([(f"l{k}", f"only text of language {k}") for k in range(6)], "lang string, text string")
    copied = copied.crossJoin(spark.range(2000)).drop("id")
    wide = spark.createDataFrame([("zh", chr(0x4E00 + i) * 512) for i in range(300)], "lang string, text string")
    learned = language_id.learn(copied.unionByName(wide))
    assert {k: v.decode() for k, v in learned.items() if k != "zh"} == {f"l{k}": f"only text of language {k}" for k in range(6)}
    seen = {ord(c) - 0x4E00 for c in learned["zh"].decode(errors="ignore")} - {ord("\n") - 0x4E00}
    assert min(seen) < 150 and len(learned["zh"]) == language_id.DICTIONARY_BYTES  # not only the last by content


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    folder = scratch_path(spark, "ids")
    files = materialise(token_ids.write_token_files(nothing, folder, BYTE, 2), "files")
    histogram = token_counts.length_histogram(token_counts.token_lengths(nothing, BYTE, ["source"]), ["source"])
    for frame in (
        exact_dedup.exact_groups(nothing), exact_dedup.without_copies(nothing), ngram_join.near_groups(nothing),
        ngram_join.without_near_copies(nothing), sharding.shard_documents(nothing, 3), packing.pack_documents(nothing, WORD, 0),
        mixing.mix(nothing, mixing.damped_weights(nothing, 100), 10), mixing.mixed(nothing, mixing.damped_weights(nothing, 100), 10),
        quality.quality_verdicts(nothing, labels), quality.without_bad(nothing, labels), token_ids.read_token_files(files, folder),
        token_counts.limit_table(histogram, ["source"]), language_id.identify(nothing, {"en": b"the"}, ["doc_id"]),
    ):
        assert frame.count() == 0


def test_numbered(spark):
    frame = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") % 7).alias("size"))
    got = numbered(frame, ["k"], ["id"], 9, "n", ("size", "before")).collect()
    for key in range(3):
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(len(mine)))
        total = 0
        for r in mine:
            assert r.before == total
            total += r["size"]
