"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleframe.llm import (
    bpe,
    chat,
    digests,
    fingerprints,
    impact_search,
    language,
    line_dedup,
    mixing,
    near_dedup,
    pii,
    prefix_trie,
    quality_rank,
    quality_rules,
    turn_repair,
)
from tripleframe.llm.common import table, written
from tripleframe.queries import Registry

registry = Registry()

_WORDS = r"[x FOR x IN string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+') IF x <> '']"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _rules_sql() -> str:
    parts = []
    for name, low, high in quality_rules.RULES:
        parts += [f"coalesce({name} >= {low}, false)"] if low is not None else []
        parts += [f"coalesce({name} <= {high}, false)"] if high is not None else []
    return " AND ".join(parts)


@registry.add()
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sizes = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    removed = line_dedup.removed_lines(docs)
    return sizes.join(removed, "doc_id", "left").select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )


@registry.add(
    rf"""
    WITH d AS (
      SELECT doc_id, text, {_WORDS} AS w,
        [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^ \x09-\x0D]')] AS l
      FROM documents),
    windows AS (
      SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (
      SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM repeated) GROUP BY doc_id),
    m AS (
      SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        coalesce(length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')), 0) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines,
        len([x FOR x IN w IF list_contains({_sql_list(quality_rules.STOP_WORDS)}, x)]) AS n_stop
      FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id),
    r AS (
      SELECT *, word_chars / nullif(n_words, 0) AS chars_per_word, n_symbols / nullif(n_words, 0) AS symbols_per_word,
        n_stop / nullif(n_words, 0) AS stop_word_share, n_dup_lines / nullif(n_lines, 0) AS dup_line_share,
        n_words / nullif(n_lines, 0) AS words_per_line,
        n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
      FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
      n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
      NOT base_failed AND {_rules_sql()} AS kept
    FROM r
    """
)
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, folder, "documents"))
    m = F.col("measures")
    return judged.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
    )


@registry.add()
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.repetitions(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies"
    )


@registry.add()
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, folder, "documents"))


@registry.add()
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.counts_and_spans(table(spark, folder, "documents"))


@registry.add()
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"))


@registry.add(
    """
    SELECT conv_id, turn, 0::INTEGER AS part, role, 0::INTEGER AS kind, NULL::VARCHAR AS call_id, 0::INTEGER AS level,
      turn AS order_turn, NULL::BIGINT AS linked_turn, 'ok' AS status,
      CAST(json_object('content', coalesce(text, ''), 'role', role) AS VARCHAR) AS json
    FROM conversations
    WHERE NOT (coalesce(role, '') IN ('assistant', 'tool') AND text LIKE '{%')
    """
)
def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(table(spark, folder, "conversations"))


@registry.add()
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@registry.add()
def op9_quality_rank(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rank.rank_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registry.add()
def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def _damaged(rows: DataFrame) -> DataFrame:
    """The damage that the contract of op11 asks for, by the checksum of ``conv_id:turn``."""
    or_space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    conv, turn, role, text = or_space
    how = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    emptied = F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        rows.filter(how != 0)
        .select("conv_id", "turn", F.when(how == 4, "user").otherwise(role).alias("role"), emptied.alias("text"), F.explode(copies))
        .drop("col")
    )


@registry.add()
def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    found = turn_repair.repair(_damaged(rows))
    lines = found.rows.select("conv_id", "out_idx", F.concat("role", F.lit(":"), "text").alias("line"))
    digest = digests.ordered_sha256(lines, "conv_id", "out_idx", "line", "\n")
    parts = rows.select(F.col("conv_id").alias("c")).distinct()
    summary, zero = found.summary, F.lit(0).cast("long")
    joined = parts.join(summary, F.col("c").eqNullSafe(F.col("conv_id")), "left").join(
        digest, F.col("c").eqNullSafe(F.col("k")), "left"
    )
    counts = [F.coalesce(x, zero).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        F.col("c").alias("conv_id"),
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(digests.EMPTY)).alias("repaired_sha256"),
    )


def _rebuilt_turns(rows: DataFrame) -> DataFrame:
    """The turns of every conversation as the contract of op12 rebuilds them: (conv_id, at, id, size)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.filter("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.substring(text, 1, 64).alias("head"),
        prefix_trie.turn_id(role, text).alias("id"),
        F.octet_length(text).alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "head", "id")
    placed = written(turns.select("conv_id", "id", "size", (F.row_number().over(order) - 1).alias("at")))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = placed.select("conv_id").distinct().withColumn("taken", taken)
    start = convs.select("conv_id", "taken", (F.col("conv_id") - F.col("conv_id") % 5).alias("first"))
    heads = placed.filter("conv_id % 5 = 0 AND at < 8").withColumnRenamed("conv_id", "first")
    given = start.join(heads, "first").filter("at < taken").select("conv_id", "at", "id", "size")
    own = placed.filter(F.col("at") >= taken).select("conv_id", "at", "id", "size")
    none = convs.select("conv_id", F.lit(-1).alias("at"), F.lit(None).cast("binary").alias("id"), F.lit(None).cast("int").alias("size"))
    return given.unionByName(own).unionByName(none)


# CRC-32 of a decimal number, bit by bit.
_CRC = """
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)
"""


@registry.add(
    f"""
    WITH t AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {_CRC} % 9 AS taken FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (
      SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos < c.taken
      UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.taken),
    a AS (
      SELECT conv_id, 0::BIGINT AS depth, 0::BIGINT AS size, '' AS path FROM c
      UNION ALL
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos), octet_length(encode(text))::BIGINT,
        sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
          OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
      FROM r),
    node AS (SELECT path, depth, any_value(size) AS size, count(*) AS n, min(conv_id) AS conv_id FROM a GROUP BY path, depth),
    ends AS (
      SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
      FROM (SELECT * FROM a QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY path),
    above AS (
      SELECT DISTINCT x.path, y.path AS top, x.depth - y.depth AS steps
      FROM a x JOIN a y ON y.conv_id = x.conv_id AND y.depth <= x.depth),
    kids AS (SELECT top, count(*) AS n FROM above WHERE steps = 1 GROUP BY top),
    sums AS (
      SELECT above.top, sum((n.n - 1) * n.size) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
      FROM above JOIN node n USING (path) LEFT JOIN kids k ON k.top = above.path GROUP BY above.top)
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs,
      coalesce(k.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
      sha256(coalesce(e.ids, '')) AS ends_sha256
    FROM node n JOIN sums s ON s.top = n.path LEFT JOIN kids k ON k.top = n.path LEFT JOIN ends e ON e.path = n.path
      LEFT JOIN above u ON u.path = n.path AND u.steps = 1 LEFT JOIN node p ON p.path = u.top
    """
)
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = _rebuilt_turns(table(spark, folder, "conversations"))
    return prefix_trie.nodes(prefix_trie.turn_keys(turns)).drop("path", "parent")


@registry.add(
    """
    WITH v AS (
      SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.uid, q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.uid <> q.uid
      WHERE q.vec_id % 50 = 0),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """
)
def op13_impact_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = impact_search.integer_vectors(table(spark, folder, "embeddings"))
    return impact_search.top_k(vectors, vectors.filter("vec_id % 50 = 0")).drop("processed")
