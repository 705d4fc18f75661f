"""The prefix trie against one built from whole rebuilt conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidewatch.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, c string, d int, no int, m int"
HEADS = "conv_id bigint, base bigint, head bigint"
LOWEST = -(2**63)
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(turns, heads):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        own[LOWEST if conv is None else conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(rows)] for c, rows in own.items()}
    heads = {LOWEST if c is None else c: (base, h) for c, base, h in heads}
    out = {}
    for c, rows in own.items():
        base, h = heads.get(c, (c, 0))
        out[c] = own.get(base, [])[:h] + rows[h:]
    return out


def brute_force(turns, heads):
    members = defaultdict(list)
    for c, rows in rebuilt(turns, heads).items():
        for d in range(len(rows) + 1):
            members[tuple(rows[:d])].append((c, len(rows)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    found = {}

    def visit(node):
        kids = [visit(k) for k in children[node]]
        leaves = sum(k[0] for k in kids) or 1
        saved = sum(k[1] for k in kids) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c in sorted(c for c, n in members[node] if n == len(node)))
        up = min(members[node[:-1]])[0] if node else None
        conv = min(members[node])[0]
        assert (conv, len(node)) not in found
        found[conv, len(node)] = (up, len(members[node]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        visit(())
    return found


def run(spark, turns, heads, parts=4, **more):
    frame = spark.createDataFrame([(*t, "x", 1, 2, 3) for t in turns], SCHEMA).repartition(parts)
    out = prefix_trie.prefix_trie(frame, spark.createDataFrame(heads, HEADS), **more)
    names = ["parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = out.collect()
    got = {(r["conv_id"], r["depth"]): tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


def sample(seed, convs=60):
    rnd = random.Random(seed)
    turns = []
    for c in range(convs):
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            turns.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "é", ""])))
    heads = [(c, c - c % 5, zlib.crc32(str(c).encode()) % 9) for c in range(convs)]
    return turns, heads


def test_trie_of_shared_heads(spark):
    turns, heads = sample(1)
    got = run(spark, turns, heads)
    assert got == brute_force(turns, heads)
    assert max(v[2] for v in got.values()) > 1 and max(d for _, d in got) > 8


def test_nulls_ties_long_texts_and_repeated_rows(spark):
    long_text = "long " * 40_000
    turns = [
        (None, None, None, None), (None, 1, "user", "x"), (1, None, "user", "late"), (1, 0, "user", "x"), (1, 0, "user", "x"),
        (2, 3, "b", "tie"), (2, 3, "a", "tie"), (2, 3, "a", "other"), (3, 0, "user", long_text), (4, 0, "user", long_text), (4, 1, None, ""),
        (5, 0, "ab", "c"), (6, 0, "a", "bc"), (-7, 0, "user", "x"), (8, 0, "user", "gone"), (9, 0, "user", "gone"),
    ]
    heads = [(None, 1, 2), (4, 3, 1), (5, 99, 0), (-7, 1, 1), (8, 99, 4), (9, 99, 4)]
    got = run(spark, turns, heads)
    assert got == brute_force(turns, heads)
    assert got[LOWEST, 0][1] == 10


def test_long_conversation_and_paths_that_hang_on_paths(spark):
    """One conversation of many turns, cut over tasks and stretches; each of the others leaves the one before it."""
    turns = [(0, i, "user", str(i % 7)) for i in range(25_000)]
    for c in range(1, 24):
        turns += [(c, i, "user", str(i % 7) if i < c else f"own {min(i, c)}") for i in range(30)]
    heads = [(40, 0, 3)]
    got = run(spark, turns, heads)
    # The brute force holds whole prefixes, so the long conversation is taken short there.
    few = [t for t in turns if t[0] or t[1] < 40]
    want = brute_force(few, heads)
    short = {k: v for k, v in got.items() if k[0] or k[1] < 40}
    want = {k: v for k, v in want.items() if k[0] or k[1] < 40}
    assert short.keys() == want.keys() and {k: v[:5] for k, v in short.items()} == {k: v[:5] for k, v in want.items()}
    assert got[0, 25_000] == (0, 1, 0, 1, 0, hashlib.sha256(b"0").hexdigest())
    assert len([k for k in got if k[0] == 0]) == 25_001


def test_many_ends_at_one_node(spark):
    turns = [(c, 0, "user", "hello") for c in range(0, 30_000, 3)]
    got = run(spark, turns, [])
    ends = ",".join(str(c) for c in range(0, 30_000, 3))
    assert got[0, 1] == (0, 10_000, 0, 1, 5 * 9_999, hashlib.sha256(ends.encode()).hexdigest())
    assert got[0, 0] == (None, 10_000, 1, 1, 5 * 9_999, EMPTY)


def test_false_fingerprints_are_seen_and_left(spark):
    """Lanes of tiny primes make sequences of different turns meet; the check of the nodes has to find them."""
    turns, heads = sample(2, 30)
    assert run(spark, turns, heads, lanes=((5, 2), (7, 3))) == brute_force(turns, heads)


def test_empty_table(spark):
    assert run(spark, [], []) == {}


def test_equal_hashes_of_different_turns_are_seen(spark, monkeypatch):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.same_turns(frame, 0)
    monkeypatch.setattr(prefix_trie, "_hashes", lambda seed: [F.lit(1).alias("x1"), F.lit(2).alias("x2")])
    assert not prefix_trie.same_turns(frame, 0)


@pytest.mark.parametrize("exponent", [0, 1, 63, 64, 4097, 10**9])
def test_powers(spark, exponent):
    from pyspark.sql import functions as F

    prime, base = prefix_trie.LANES[0]
    got = spark.range(1).select(prefix_trie.powers(base, prime, F.lit(exponent).cast("bigint"))).first()[0]
    assert got == pow(base, exponent, prime)
