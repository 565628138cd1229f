"""Queries opN_<name>: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from floodspark.llm import chat, decontam, fim, hardneg, langid, maxent, neardup, packing, quality, secrets, sharding, tokens, toxicity
from floodspark.llm.text import crc_mod, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return chat.digests(chat.read_back(chat.render(chat.fold_events(_as_log(rows.unionByName(more))))))


def _as_log(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) as the events that a chat's log has of them: a draft first; then, by turns, its text in three
    streamed pieces after a regeneration, or an edit, or a second message; one event of each comes twice."""
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    third = F.floor(n / 3).cast("int")
    event = lambda seq, kind, role, x: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), x.alias("text"))
    none = F.lit(None).cast("string")
    draft = event(0, "message", F.col("role"), F.reverse(text))
    pieces = [F.substr(text, F.lit(1), third), F.substr(text, third + 1, third), F.substr(text, 2 * third + 1, n)]
    streamed = F.array(draft, event(1, "regenerate", none, none), *[event(2 + i, "delta", none, p) for i, p in enumerate(pieces)], event(2, "delta", none, pieces[0]))
    edited = F.array(draft, event(1, "delta", none, F.lit(" and more")), event(2, "edit", none, F.col("text")), event(2, "edit", none, F.col("text")))
    again = F.array(draft, draft, event(1, "message", none, F.col("text")))
    way = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))
    events = F.when(way == 0, streamed).when(way == 1, edited).otherwise(again)
    x = messages.withColumn("message", F.monotonically_increasing_id()).select("conv_id", "turn", "message", F.explode(events).alias("e"))
    return x.select("conv_id", "turn", "message", "e.*")


def op2_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, limit=1 << 20).select("doc_id", "n_bytes", "shard", "depth", "overflow")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    return langid.predict(docs, langid.fit(docs, ~F.col("held_out")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out))


def op11_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    return maxent.score(table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restored(fim.transform(table(spark, sf_dir, "documents")))
    digests = [F.sha2(c, 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("restored", "restored"))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hardneg.integers(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return hardneg.mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_extendible_shards,
        op3_secret_scan,
        op4_token_counts,
        op5_decontamination,
        op6_minhash_near_dedup,
        op7_length_packing,
        op8_language_id,
        op9_quality_rules,
        op10_toxicity,
        op11_maxent_scores,
        op12_fill_in_middle,
        op13_hard_negatives,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op1_chat_format"] = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS et,
    replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS er
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<s>[INST]' || er || '[/INST]' || et || '</s>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op9_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), r AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM g, (VALUES (0), (1), (2)) t(j) WHERE n > 1 GROUP BY doc_id
), s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(l) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 3 * n_words
    OR word_chars > 10 * n_words OR 10 * n_capitals > 3 * word_chars) AS kept
FROM b
"""

ORACLES["op2_extendible_shards"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    lpad(ltrim(format('{:b}', ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), '0'), 60, '0') AS address
  FROM documents
), t AS (
  SELECT doc_id, n_bytes, address, 0 AS depth, (SELECT sum(n_bytes) FROM d) AS total FROM d
  UNION ALL
  SELECT doc_id, n_bytes, address, depth + 1,
    sum(n_bytes) OVER (PARTITION BY substr(address, 1, depth + 1))
  FROM t WHERE total > 1048576 AND depth < 60
)
SELECT doc_id, n_bytes, substr(address, 1, depth) AS shard, depth::INTEGER AS depth, 0::BIGINT AS overflow
FROM t WHERE total <= 1048576
"""

ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), r AS (
  SELECT doc_id, text, t, len(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(t) + 1) AS r1,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(t) + 1) AS r2, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS r4
  FROM d
), p AS (
  SELECT doc_id, text, n, array_to_string(t[1:least(r1, r2)], '') AS prefix, array_to_string(t[least(r1, r2) + 1:greatest(r1, r2)], '') AS middle,
    array_to_string(t[greatest(r1, r2) + 1:n], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r3 >= 90 THEN 'plain'
      WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

ORACLES["op13_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
