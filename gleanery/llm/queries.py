"""Thin registered queries of the corpus operators, with production parameters, and their SQL oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import chat, decontam, itq, langid, linededup, minhash, packing, sharding, tokens, toxicity
from gleanery.llm.common import fold, read


def _vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    out = langid.identify_languages(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_pigeonhole_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85, rounds=0)


def op4_itq_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(read(spark, sf_dir, "embeddings"), least=0.95)


def packed(docs: DataFrame) -> DataFrame:
    pieces = tokens.token_pieces(docs, _vocabulary(), capacity=2048, end_id=0)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, capacity=2048)


def op5_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def op6_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    out = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.lpt_shards(read(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents"), exact_words=1)
    return out.select("doc_id", "n_lines", "n_removed", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "emptied")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), _vocabulary(), most=2048)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.chat_digests(chat.parse_chats(chat.format_chats(turns.unionByName(more))))


QUERIES = {
    "op1_ppm_language": op1_ppm_language,
    "op2_pigeonhole_matches": op2_pigeonhole_matches,
    "op3_minhash_groups": op3_minhash_groups,
    "op4_itq_groups": op4_itq_groups,
    "op5_slack_packing": op5_slack_packing,
    "op6_kernel_toxicity": op6_kernel_toxicity,
    "op7_lpt_shards": op7_lpt_shards,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_chat_format": op10_chat_format,
}

#: Components of the links l(a, b), both directions, over the nodes v(id): id and component.
_COMPONENTS = """reach AS (SELECT id, id AS other FROM v UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.other),
parts AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""

ORACLES = {
    "op3_minhash_groups": rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT id, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [md5(array_to_string(words, ' '))]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(words[i:i + 4], ' ')))) END AS shingles FROM w),
e AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY x.doc_id, y.doc_id),
k AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (na + nb - common)),
l AS MATERIALIZED (SELECT a, b FROM k UNION SELECT b, a FROM k),
v AS (SELECT DISTINCT doc_id AS id FROM documents),
{_COMPONENTS}
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component AS component_id, component = s.doc_id AS kept FROM s JOIN parts ON parts.id = s.doc_id
""",
    "op4_itq_groups": f"""
WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) >= 0.95),
v AS (SELECT vec_id AS id FROM embeddings),
{_COMPONENTS}, n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, component AS component_id, component = vec_id AS kept FROM embeddings JOIN parts ON parts.id = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "op10_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(replace(replace(text, '\', '\e'), '<', '\m')) + length(replace(replace(role, '\', '\e'), '<', '\m')) + 19) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
                     WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END)
         AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM placed GROUP BY conv_id
""",
}
