"""The prefix trie of conversations that share heads, from fingerprints that compose.

The fingerprint of a sequence of turns ``t0 t1 ... tn`` is ``sum(ti * base^i)`` modulo a prime, in three lanes. It is a monoid:
``A + B`` has ``fp(A) + base^len(A) * fp(B)``, and a stretch from turn h on is ``(fp(n) - fp(h)) * base^-h``. So the
fingerprint of every prefix of a conversation that is rebuilt from a base's head and its own suffix follows from the
prefix sums of the two originals; rebuilt texts never exist. A rebuilt turn is a reference to an original one.

Equal prefixes are one node. A node is named by its smallest member m and its depth; the nodes of one m lie below each
other, so the trie falls into one path per conversation at most, and paths hang on paths. Subtree sums are suffix sums
along a path over what its nodes hold and what hangs on them; what a whole hanging path holds is summed up by pointer
doubling over paths, in as many rounds as the logarithm of how deep paths hang on paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count as count_up

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import BUCKET_ROWS, NO_ID, numbered
from tidewatch.session import materialise

Lanes = Sequence[tuple[int, int]]

#: Fixed values: (prime below 2^31, base) of each lane.
LANES: Lanes = ((2147483647, 1000003), (2147483629, 40009007), (2147483587, 7368787))
#: Exponents are written in this base; six digits suffice.
DIGIT = 64
DIGITS = 6
#: Conversation numbers that share all but so many low bits are joined to one string before they are hashed.
ID_BITS = 12


def powers(base: int, prime: int, exponent: Column) -> Column:
    """base^exponent modulo the prime, for exponents from 0 to DIGIT^DIGITS, out of one small constant table per digit."""
    out = None
    for place in range(DIGITS):
        step = pow(base, DIGIT**place, prime)
        table = F.expr(f"array({', '.join(f'{pow(step, k, prime)}L' for k in range(DIGIT))})")
        digit = F.shiftright(exponent, 6 * place).bitwiseAND(F.lit(DIGIT - 1)).cast("int")
        factor = F.get(table, digit)
        out = factor if out is None else F.pmod(out * factor, F.lit(prime))
    return out


def _q(lanes: Lanes, prefix: str = "q") -> list[str]:
    return [f"{prefix}{k}" for k in range(len(lanes))]


def _value(k: int, prime: int) -> Column:
    """A turn's number in a lane, from the two hashes of its role and text."""
    return F.pmod(F.xxhash64("x1", "x2", F.lit(k)), F.lit(prime))


def _plain(turns: DataFrame) -> DataFrame:
    empty = F.lit("")
    return turns.select(
        F.coalesce(turns["conv_id"].cast("bigint"), F.lit(NO_ID)).alias("c"),
        turns["turn"].alias("turn"),
        F.coalesce(turns["role"], empty).alias("role"),
        F.coalesce(turns["text"], empty).alias("text"),
    )


def _hashes(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + i), "role", "text").alias(f"x{i + 1}") for i in (0, 1)]


def same_turns(turns: DataFrame, seed: int) -> bool:
    """Whether turns with equal hashes are equal, by whole roles and texts; equal turns are reduced before the shuffle."""
    whole = F.struct("role", "text")
    groups = _plain(turns).select(*_hashes(seed), whole.alias("w")).groupBy("x1", "x2").agg(F.min("w").alias("a"), F.max("w").alias("b"))
    return groups.filter("a <> b").isEmpty()


def turn_store(turns: DataFrame, seed: int = 0, lanes: Lanes = LANES) -> DataFrame:
    """One narrow row per turn: c, no (from 0), x1, x2 (its hashes), bytes of its text, q0.. (fingerprint of turns 0 to no).

    Turns are ordered by turn (null first), then role, then md5 of the text. A conversation may hold most rows: the rows are
    range-partitioned by (c, order), numbered within ranges, and summed up in stretches of BUCKET_ROWS turns.
    """
    rows = _plain(turns).select("c", "turn", "role", F.md5("text").alias("digest"), F.octet_length("text").cast("bigint").alias("bytes"), *_hashes(seed))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = sorted_rows.select("c", "bytes", "x1", "x2", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    kept = materialise(kept, "turns-in-order")
    rows = numbered(kept, ["c"], ["at"], 0, "no", bucket=F.col("part")).select("c", "no", "bytes", "x1", "x2")
    terms = {f"v{k}": F.pmod(_value(k, p) * powers(b, p, F.col("no")), F.lit(p)) for k, (p, b) in enumerate(lanes)}
    rows = rows.withColumns(terms | {"stretch": _stretch(F.col("no"))})
    sums = _running(rows, "c", "no", list(terms))
    return sums.select("c", "no", "x1", "x2", "bytes", *[F.pmod(f"v{k}", F.lit(p)).alias(f"q{k}") for k, (p, _) in enumerate(lanes)])


def _stretch(number: Column) -> Column:
    return F.call_function("div", number, F.lit(BUCKET_ROWS).cast("bigint"))


def _running(rows: DataFrame, key: str, order: str, columns: list[str], backwards: bool = False) -> DataFrame:
    """Replace ``columns`` by their sums over the rows of ``key`` up to this one (from this one on if ``backwards``).

    ``stretch`` cuts the rows of a key, in order, into pieces of bounded size.
    """
    by = (lambda c: F.col(c).desc()) if backwards else F.col
    before = Window.partitionBy(key).orderBy(by("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "stretch").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    starts = starts.select(key, "stretch", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    within = Window.partitionBy(key, "stretch").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(starts, [key, "stretch"]).withColumns({c: F.col(f"_{c}") + F.sum(c).over(within) for c in columns}).drop(*[f"_{c}" for c in columns])


def rebuilt_prefixes(store: DataFrame, heads: DataFrame, lanes: Lanes = LANES) -> DataFrame:
    """Every prefix of every rebuilt conversation: c, d (its length), q0.. and x1, x2, bytes of its last turn.

    ``heads`` (c, base, head) says how many turns of which conversation stand in for a conversation's own first turns; one
    without a row keeps its own. Only turns below the greatest head meet the heads, so a long base costs nothing.
    """
    q = _q(lanes)
    heads = store.select("c").distinct().join(heads, "c", "left").select("c", F.coalesce("base", "c").alias("base"), F.coalesce("head", F.lit(0)).cast("bigint").alias("head"))
    heads = materialise(heads, "heads")
    most = heads.agg(F.max("head")).first()[0] or 0
    first = store.filter(F.col("no") < most)
    taken = heads.join(first.withColumnRenamed("c", "base"), "base").filter("no < head")
    head_rows = materialise(taken.select("c", (F.col("no") + 1).alias("d"), *q, "x1", "x2", "bytes"), "head-rows")
    based = head_rows.groupBy("c").agg(F.max("d").alias("len"), *[F.max_by(f, "d").alias(f"b_{f}") for f in q])
    own = first.join(heads, "c").filter("no = head - 1").select("c", *[F.col(f).alias(f"o_{f}") for f in q])
    zero = F.lit(0).cast("bigint")
    offsets = heads.join(based, "c", "left").join(own, "c", "left")
    shift = {f"s_{f}": powers(pow(b, -1, p), p, F.col("head") - F.col("len")) for f, (p, b) in zip(q, lanes, strict=True)}
    offsets = offsets.fillna(0).withColumns(shift).drop("base")
    placed = {f: F.pmod(F.col(f"b_{f}") + F.col(f"s_{f}") * F.pmod(F.col(f) - F.col(f"o_{f}"), F.lit(p)), F.lit(p)) for f, (p, _) in zip(q, lanes, strict=True)}
    suffix = store.join(offsets, "c").filter("no >= head")
    own_rows = suffix.select("c", (F.col("no") - F.col("head") + F.col("len") + 1).alias("d"), *[v.alias(f) for f, v in placed.items()], "x1", "x2", "bytes")
    roots = heads.select("c", zero.alias("d"), *[zero.alias(f) for f in [*q, "x1", "x2", "bytes"]])
    return roots.unionByName(head_rows).unionByName(own_rows)


def trie_nodes(prefixes: DataFrame, lanes: Lanes = LANES) -> DataFrame:
    """One row per node: d, q0.., conv_id (smallest member), n_convs, bytes, p0.. (its parent's fingerprint), sound.

    ``sound`` is false where members of one fingerprint end in different turns. Where all nodes are sound, members are equal:
    an equal last turn taken off equal fingerprints leaves equal fingerprints one turn shorter, and so on to the root.
    """
    q = _q(lanes)
    groups = prefixes.groupBy("d", *q).agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"),
        F.min("x1").alias("x1"), F.min("x2").alias("x2"), F.max("x1").alias("y1"), F.max("x2").alias("y2"),
    )
    up = F.greatest(F.col("d") - 1, F.lit(0))
    parents = [F.pmod(F.col(f) - F.pmod(_value(k, p) * powers(b, p, up), F.lit(p)), F.lit(p)).alias(f"p{k}") for k, (f, (p, b)) in enumerate(zip(q, lanes, strict=True))]
    sound = (F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2"))
    return groups.select("d", *q, "conv_id", "n_convs", "bytes", *parents, sound.alias("sound"))


def _paths(nodes: DataFrame, lanes: Lanes) -> DataFrame:
    """One row per path: m, top, end, saved, leaf, and its place: up (the path it hangs on) and that node's key."""
    q = _q(lanes)
    paths = nodes.groupBy(F.col("conv_id").alias("m")).agg(
        F.min("d").alias("top"), F.max("d").alias("end"), F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        *[F.min_by(f"p{k}", "d").alias(f"p{k}") for k in range(len(lanes))],
    )
    on = reduce(lambda a, b: a & b, [F.col("d") == F.col("top") - 1, *[F.col(f) == F.col(f"p{k}") for k, f in enumerate(q)]])
    hung = paths.join(nodes.select("d", *q, F.col("conv_id").alias("up")), on, "left").drop("d", *q)
    hung = materialise(hung, "paths")
    bent = hung.filter(F.col("up").isNotNull()).select(F.col("up").alias("m"), (F.col("top") - 1).alias("end")).distinct()
    marked = hung.join(bent.withColumn("_bent", F.lit(True)), ["m", "end"], "left")
    return marked.withColumn("leaf", F.when(F.col("_bent"), 0).otherwise(1).cast("bigint")).drop("_bent")


def subtree_totals(paths: DataFrame, values: Sequence[str]) -> DataFrame:
    """(m, values): the sums of ``values`` over each path and all that hangs on it, at any distance.

    Pointer doubling: after k rounds a row holds what lies less than 2^k steps below it and points 2^k steps up.
    """
    state = materialise(paths.select("m", "up", *values), "totals")
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        below = state.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("m")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        higher = state.select(F.col("m").alias("up"), F.col("up").alias("_up"))
        summed = state.join(below, "m", "left").select("m", "up", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        state = materialise(summed.join(higher, "up", "left").select("m", F.col("_up").alias("up"), *values), "totals")
    return state.drop("up")


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined strings of each node, while its rows stream by in order; nothing is held but the digest."""
    key = digest = names = None
    for batch in batches:
        names = batch.schema.names[:-2]
        keys = zip(*[c.to_pylist() for c in batch.columns[:-2]], strict=True)
        done: list[tuple] = []
        for now, text in zip(keys, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if now == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256()
            digest.update(text.encode())
        yield _digests(names, done)
    if key is not None:
        yield _digests(names, [(*key, digest.hexdigest())])


def _digests(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
    arrays = [pa.array(c, pa.int64()) for c in columns[:-1]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[-1], pa.string())], [*names, "ends_sha256"])


def end_digests(prefixes: DataFrame, lanes: Lanes = LANES) -> DataFrame:
    """(d, q0.., n_ends, ends_sha256) of each node at which rebuilt conversations end.

    Numbers that differ only in their low ID_BITS are joined to one string, so a string holds 4096 numbers at most whatever the
    group. A node with one string is hashed where it lies; the strings of a larger one stream in order through one task,
    since SHA-256 has no other way.
    """
    q = _q(lanes)
    node = ["d", *q]
    ends = prefixes.groupBy("c").agg(F.max("d").alias("d"), *[F.max_by(f, "d").alias(f) for f in q])
    strings = ends.groupBy(*node, F.shiftright("c", ID_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"), F.count("*").alias("n")
    )
    strings = materialise(strings, "end-strings")
    counts = materialise(strings.groupBy(*node).agg(F.count("*").alias("chunks"), F.sum("n").alias("n_ends")), "end-counts")
    one = strings.join(counts.filter("chunks = 1"), node).select(*node, "n_ends", F.sha2("ids", 256).alias("ends_sha256"))
    large = counts.filter("chunks > 1").select(*node, "n_ends")
    streamed = strings.join(large.drop("n_ends"), node, "left_semi").select(*node, "chunk", "ids")
    schema = "".join(f"{name} bigint, " for name in node) + "ends_sha256 string"
    hashed = streamed.repartition(*node).sortWithinPartitions(*node, "chunk").mapInArrow(_hash_lists, schema)
    return one.unionByName(hashed.join(large, node).select(*one.columns))


def prefix_trie(turns: DataFrame, heads: DataFrame, lanes: Lanes = LANES) -> DataFrame:
    """The trie of all rebuilt conversations, one row per node, the root included.

    ``turns`` has conv_id, turn, role and text; other columns are not read. ``heads`` (conv_id, base, head): the first ``head``
    turns of ``base`` (all if it has fewer, none if it is absent) stand in for the first ``head`` turns of the conversation.
    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, members
    less one times the bytes of the node's last text), ends_sha256, n_ends.

    Null roles and texts are empty; null turns come first, equal turns are ordered by role and then md5 of the text; repeated rows are
    turns of their own. A null conv_id is one conversation with the number -2^63. Rows without turns after rebuilding are
    members of the root. An empty table has no members and gives no rows. Texts of any length are only hashed, compared and
    measured. Should two different turns or sequences share their hashes, all is done again with other hashes.
    """
    plain = heads.select(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("c"), F.col("base").cast("bigint").alias("base"), F.col("head").cast("bigint").alias("head"))
    for seed in count_up():
        if same_turns(turns, seed):
            store = materialise(turn_store(turns, seed, lanes), "turn-store")
            prefixes = materialise(rebuilt_prefixes(store, plain, lanes), "prefixes")
            nodes = materialise(trie_nodes(prefixes, lanes), "nodes")
            if nodes.filter("not sound").isEmpty():
                return _assembled(nodes, prefixes, lanes)
        lanes = LANES


def _assembled(nodes: DataFrame, prefixes: DataFrame, lanes: Lanes) -> DataFrame:
    q = _q(lanes)
    node = ["d", *q]
    paths = materialise(_paths(nodes, lanes), "paths-marked")
    totals = materialise(subtree_totals(paths, ["leaf", "saved"]), "path-totals")
    hanging = paths.filter(F.col("up").isNotNull()).select("m", (F.col("top") - 1).alias("d"), *[F.col(f"p{k}").alias(f) for k, f in enumerate(q)])
    hung = hanging.join(totals, "m").groupBy(*node).agg(F.count("*").alias("hung"), F.sum("leaf").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    ends = end_digests(prefixes, lanes)
    full = nodes.select(*node, F.col("conv_id").alias("m"), "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    full = full.join(hung, node, "left").join(ends, node, "left").withColumn("stretch", _stretch(F.col("d"))).fillna(0)
    full = full.withColumns({"leaves": F.col("hung_leaves"), "saved": F.col("saved") + F.col("hung_saved")})
    full = materialise(full.drop("hung_leaves", "hung_saved", *q), "full-nodes")
    summed = _running(full, "m", "d", ["leaves", "saved"], backwards=True)
    named = full.select("m", "stretch").distinct().join(paths.select("m", "top", "end", "up", "leaf"), "m")
    out = summed.join(named, ["m", "stretch"])
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("m").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("top"), F.col("up")).otherwise(F.col("m")).alias("parent_conv_id"),
        "n_convs",
        (F.col("hung") + F.when(F.col("d") < F.col("end"), 1).otherwise(0)).alias("n_children"),
        (F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        F.col("n_ends"),
    )
