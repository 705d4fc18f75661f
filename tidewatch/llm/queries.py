"""The registered queries of the operators, with their parameters and SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    chat_format,
    exact_dedup,
    language_id,
    lexical,
    mixing,
    ngram_join,
    packing,
    prefix_trie,
    quality,
    sharding,
    token_counts,
    token_ids,
    toxicity,
)
from tidewatch.llm.common import ORACLES, QUERIES, Query, query, table
from tidewatch.session import materialise, scratch_path

WORD_BPE, WORD_END_ID = "word_bpe_49k.json", 0
BYTE_BPE, BYTE_END_ID = "byte_bpe_50k.json", 2


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)


A_TO_Z = f"'{exact_dedup.UPPER}', '{exact_dedup.LOWER}'"


@query(
    "op1_exact_dedup",
    f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {A_TO_Z}) AS t FROM documents),
      g AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id,
        count(*) OVER (PARTITION BY t) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE), WORD_END_ID, special=True)


@query("op9_token_ids")
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-ids")
    docs = table(spark, sf_dir, "documents")
    files = token_ids.write_token_files(docs, folder, public_tokenizers.path(BYTE_BPE), BYTE_END_ID, special=True)
    return token_ids.read_token_files(materialise(files, "token-files"), folder)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lengths = token_counts.token_lengths(docs, public_tokenizers.path(BYTE_BPE), ["source"], special=True)
    histogram = materialise(token_counts.length_histogram(lengths, ["source"]), "length-histogram")
    return token_counts.limit_table(histogram, ["source"])


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


#: Parts of a period shared among the sources, and bytes of a block.
MIX_PARTS, MIX_BLOCK = 1000, 1 << 16


@query(
    "op5_mixing",
    f"""WITH RECURSIVE rows_ AS (
      SELECT doc_id, coalesce(source, '') AS source, strlen(coalesce(text, '')) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
    roots AS (SELECT source, sqrt(sum(size)) AS root FROM rows_ GROUP BY source),
    weights AS (SELECT source, CAST(greatest(round(root / sum(root) OVER () * {MIX_PARTS}), 1) AS BIGINT) AS parts FROM roots),
    all_ AS (SELECT list(source ORDER BY source) AS names, list(parts ORDER BY source) AS a, CAST(sum(parts) AS BIGINT) AS period FROM weights),
    edf AS (
      SELECT CAST(-1 AS BIGINT) AS t, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS given, CAST(0 AS BIGINT) AS pick FROM all_
      UNION ALL
      SELECT t, list_transform(range(1, len(a) + 1), lambda i: given[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick FROM (
        SELECT t + 1 AS t, given, a, list_min(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN (given[i] * period) // a[i] <= t + 1
          THEN (((given[i] + 1) * period + a[i] - 1) // a[i]) * 1000000 + i ELSE 9000000000000000 END)) % 1000000 AS pick
        FROM edf, all_ WHERE t + 1 < period)),
    plan AS (SELECT names[pick] AS source, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM edf, all_ WHERE t >= 0),
    ranked AS (SELECT *, row_number() OVER w - 1 AS place,
      coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
      FROM rows_ WINDOW w AS (PARTITION BY source ORDER BY h, doc_id)),
    blocks AS (SELECT *, CAST(before_ AS BIGINT) // {MIX_BLOCK} AS block FROM ranked),
    placed AS (SELECT b.*, (block // parts) * period + t AS slot FROM blocks b JOIN weights USING (source), all_, plan p
      WHERE p.source = b.source AND p.j = b.block % parts),
    nexts AS (SELECT source, max(block) + 1 AS nb FROM blocks GROUP BY source),
    horizon AS (SELECT min((nb // parts) * period + t) AS h FROM nexts n JOIN weights USING (source), all_, plan p
      WHERE p.source = n.source AND p.j = nb % parts)
    SELECT doc_id, p.source, size, block, slot, place, slot < horizon.h AS on_target FROM placed p, horizon""",
)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    places = mixing.mix(docs, mixing.damped_weights(docs, MIX_PARTS), MIX_BLOCK)
    return places.select(F.col("_id").alias("doc_id"), "source", "size", "block", "slot", "place", "on_target")


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.drop("_id", "_x")


@query(
    "op2_ngram_join",
    """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
    k AS (SELECT doc_id, w, md5(array_to_string(w, ' ')) AS c FROM w),
    classes AS (SELECT c, any_value(w) AS w, max(doc_id) AS class_id, count(*) AS n_copies FROM k GROUP BY c),
    sh AS (SELECT DISTINCT class_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM classes WHERE len(w) > 0),
    sizes AS (SELECT class_id, count(*) AS n FROM sh GROUP BY class_id),
    shared AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS n FROM sh a JOIN sh b USING (s) WHERE a.class_id <> b.class_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.class_id = a JOIN sizes y ON y.class_id = b WHERE 5 * shared.n >= 4 * (x.n + y.n - shared.n)),
    reach AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    heads AS (SELECT a, max(b) AS group_id FROM reach GROUP BY a),
    degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT doc_id, class_id, n_copies, coalesce(degree.n, 0) AS n_links, group_id, doc_id = group_id AS kept
    FROM k JOIN classes USING (c) JOIN heads ON heads.a = class_id LEFT JOIN degree ON degree.a = class_id""",
)
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents")).drop("_id", "_x")


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", _held_out())
    dictionaries = language_id.learn(docs.filter(~F.col("held_out")))
    return language_id.identify(docs, dictionaries, ["doc_id", "held_out"])


#: A conversation whose texts hold what looks like escaped control strings.
TRAP_ID, TRAP = -7, r"\### Assistant: </turn> ok"


@query(
    "op3_chat_format",
    f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT {TRAP_ID}, 0, 'user', '{TRAP}' UNION ALL SELECT {TRAP_ID}, 1, 'assistant', '{TRAP}'),
    g AS (SELECT *, length(text) + length(text) - length(replace(text, '\\', ''))
        + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7
        + length(role) + length(role) - length(replace(replace(role, '\\', ''), ':', ''))
        + (length(role) - length(replace(role, '###', ''))) // 3 + (length(role) - length(replace(role, '</turn>', ''))) // 7
        + {len("### : </turn>") + 1} AS chars FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM g GROUP BY conv_id""",
)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(TRAP_ID, 0, "user", TRAP), (TRAP_ID, 1, "assistant", TRAP)], turns.schema)
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(trap)))


#: Greatest head plus one of the rebuilt conversations, and conversations that share a base.
HEADS, SHARERS = 9, 5
CRC = """xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
      lambda a, b: list_reduce([CAST(xor(a, b) AS BIGINT)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


@query(
    "op11_prefix_trie",
    f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS no FROM conversations),
    ids AS (SELECT conv_id, conv_id - conv_id % {SHARERS} AS base, {CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM conversations)),
    rebuilt AS (SELECT i.conv_id, 0 AS part, no, {{'r': role, 'x': text}} AS t FROM ids i JOIN t ON t.conv_id = i.base AND no < h
      UNION ALL SELECT i.conv_id, 1, no, {{'r': role, 'x': text}} FROM ids i JOIN t USING (conv_id) WHERE no >= h),
    seqs AS (SELECT conv_id, coalesce(list(t ORDER BY part, no) FILTER (t IS NOT NULL), []) AS s FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
    prefixes AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM seqs),
    nodes AS (SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256 FROM prefixes GROUP BY 1, 2),
    kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
    tree AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].x) END AS saved FROM nodes n LEFT JOIN kids USING (p)),
    below AS (SELECT p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
      FROM (SELECT *, unnest(range(d + 1)) AS a FROM tree) GROUP BY 1)
    SELECT tree.conv_id, tree.d AS depth, up.conv_id AS parent_conv_id, tree.n_convs, tree.n_children, n_leaves, saved_tokens, tree.ends_sha256
    FROM tree JOIN below USING (p) LEFT JOIN tree up ON tree.d > 0 AND up.p = tree.p[1:tree.d - 1]""",
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    c = F.col("conv_id")
    head = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(HEADS))
    heads = turns.select("conv_id").distinct().select("conv_id", (c - c % SHARERS).alias("base"), head.alias("head"))
    return prefix_trie.prefix_trie(turns, heads).drop("n_ends")


#: Results of an item.
TOP = 20
TERMS = f"regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query(
    "op13_lexical_search",
    f"""WITH tok AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
    post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY ALL),
    c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM lens),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM post, c WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
    s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // l)))) AS BIGINT) AS score
      FROM q JOIN post USING (term) JOIN w USING (term) JOIN lens USING (doc_id), c GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= {TOP}""",
)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), TOP)


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _held_out())
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.learn(docs.filter(~F.col("held_out")), labels)
    out = toxicity.score(docs, model, ["doc_id", "held_out"])
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
