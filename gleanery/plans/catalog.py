"""Registered queries of the retrieval engine and their SQL oracles.

Documents stand for pages (their lines for blocks), benchmark items for questions, embeddings for
the vectors of documents of the same id, conversations for pairs of question and answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.config import RetrievalConfig
from gleanery.functions import text as tx
from gleanery.operators import chunking, context, evaluation, evidence, planning, retrieval, sinks, units
from gleanery.plans import sql as q
from gleanery.sources import readers

CONFIG = RetrievalConfig()

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return readers.read_table(spark, folder, name)


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return readers.text_blocks(_table(spark, folder, "documents"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks of their own."""
    return _table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_index"), "text")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), tx.normalize_space(F.col("text")).alias("query"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(answered, ["conv_id", "turn"])


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_index"), "embedding")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with the vector of their own id, where there is one."""
    return _questions(spark, folder).join(_table(spark, folder, "embeddings").select(F.col("vec_id").alias("qid"), "embedding"), "qid", "left")


# Blocks and chunks.


@query(f"WITH {q.BLOCKS} SELECT page, block_no, chunk_index, source_title, text FROM blocks")
def block_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _blocks(spark, folder).select("page", "block_no", "chunk_index", "source_title", "text")


@query(f"WITH {q.BLOCKS} SELECT min(chunk_index) AS chunk_index, arg_min(text, chunk_index) AS text FROM blocks GROUP BY substr({q.space('text')}, 1, 900)")
def distinct_first(spark: SparkSession, folder: str) -> DataFrame:
    return readers.union_chunks(_blocks(spark, folder)).select("chunk_index", "text")


@query(f"SELECT page_id, {q.clean('html')} AS cleaned, {q.space('html')} AS spaced FROM pages")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "pages").select("page_id", tx.clean_text(F.col("html")).alias("cleaned"), tx.normalize_space(F.col("html")).alias("spaced"))


@query(f"WITH {q.BLOCKS} SELECT page, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS n FROM blocks GROUP BY page")
def page_lengths(spark: SparkSession, folder: str) -> DataFrame:
    blocks = _blocks(spark, folder)
    return evaluation.page_lengths(blocks).join(blocks.groupBy("page").agg(F.count(F.lit(1)).alias("n")), "page")


@query(f"""WITH RECURSIVE docs AS (SELECT doc_id, {q.clean('text')} AS t FROM documents WHERE text IS NOT NULL),
step AS (
  SELECT doc_id, t, 0 AS sub_no, 0 AS pos, least(900, length(t)) AS stop FROM docs WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, sub_no + 1, ending - 120, least(ending - 120 + 900, length(t)) FROM (
    SELECT doc_id, t, sub_no, pos, CASE WHEN stop < length(t) AND place > 495 THEN pos + place + 1 ELSE stop END AS ending FROM (
      SELECT *, greatest(CASE WHEN contains(p, chr(10)) THEN length(p) - instr(reverse(p), chr(10)) ELSE -1 END,
        CASE WHEN contains(p, '. ') THEN length(p) - instr(reverse(p), ' .') - 1 ELSE -1 END,
        CASE WHEN contains(p, '? ') THEN length(p) - instr(reverse(p), ' ?') - 1 ELSE -1 END,
        CASE WHEN contains(p, '다.') THEN length(p) - instr(reverse(p), '.다') - 1 ELSE -1 END) AS place
      FROM (SELECT *, substr(t, pos + 1, stop - pos) AS p FROM step))) WHERE ending < length(t)),
ended AS (SELECT doc_id, sub_no, t, pos, CASE WHEN stop < length(t) AND place > 495 THEN pos + place + 1 ELSE stop END AS ending FROM (
      SELECT *, greatest(CASE WHEN contains(p, chr(10)) THEN length(p) - instr(reverse(p), chr(10)) ELSE -1 END,
        CASE WHEN contains(p, '. ') THEN length(p) - instr(reverse(p), ' .') - 1 ELSE -1 END,
        CASE WHEN contains(p, '? ') THEN length(p) - instr(reverse(p), ' ?') - 1 ELSE -1 END,
        CASE WHEN contains(p, '다.') THEN length(p) - instr(reverse(p), '.다') - 1 ELSE -1 END) AS place
      FROM (SELECT *, substr(t, pos + 1, stop - pos) AS p FROM step)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sub_no) - 1 AS INTEGER) AS sub_no, piece FROM (SELECT doc_id, sub_no, {q.clean('substr(t, pos + 1, ending - pos)')} AS piece FROM ended) WHERE piece <> ''""")
def split_long_text(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.split_long_text(_table(spark, folder, "documents").where("text IS NOT NULL"), "doc_id", "text", 900, 120)


@query("""SELECT n_regionkey AS key, '| ' || 'id' || ' | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def table_markdown(spark: SparkSession, folder: str) -> DataFrame:
    nations = _table(spark, folder, "nation")
    cells = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    head = F.array(F.array(F.lit("id"), F.lit("name")))
    tables = nations.groupBy(F.col("n_regionkey").alias("key")).agg(F.concat(head, F.transform(cells, lambda c: F.array(c["n_nationkey"].cast("string"), c["n_name"])), F.array(F.array(F.lit(" "), F.lit(None).cast("string")))).alias("cells"))
    return tables.select("key", chunking.table_markdown(F.col("cells")).alias("markdown"))


_PAGE_BLOCKS = r"regexp_replace(regexp_replace(html, '<h1>', chr(10) || '1. ', 'g'), '<[^>]+>', chr(10), 'g')"


@query(rf"""WITH lines AS (SELECT page_id, unnest(string_split({_PAGE_BLOCKS}, chr(10))) AS raw, generate_subscripts(string_split({_PAGE_BLOCKS}, chr(10)), 1) - 1 AS block_no FROM pages),
b AS (SELECT page_id, block_no, {q.clean('raw')} AS text FROM lines WHERE {q.clean('raw')} <> ''),
h AS (SELECT *, regexp_matches({q.space('text')}, '^(\d{{1,2}})\.\s+(.+)$') AND NOT regexp_matches({q.space('text')}, '··|…') AND length({q.space('text')}) <= 140 AND NOT contains({q.heading_title('text')}, '다음과같습니다') AS head FROM b),
s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY page_id ORDER BY block_no) AS section_no FROM h),
g AS (SELECT page_id, section_no, min(block_no) AS first_block, count(*) AS n_blocks, {q.space('arg_min(text, block_no)')} AS anchor_text, array_to_string(list_slice(list(text ORDER BY block_no), 2, 1000000), chr(10)) AS body FROM s WHERE section_no > 0 GROUP BY page_id, section_no)
SELECT page_id AS doc, CAST(section_no AS BIGINT) AS section_no, first_block, n_blocks, anchor_text, body FROM g WHERE n_blocks >= 2 AND length(anchor_text) + length(body) + 1 >= 30 AND length(body) >= 10""")
def section_group(spark: SparkSession, folder: str) -> DataFrame:
    marked = F.regexp_replace(F.regexp_replace("html", "<h1>", "\n1. "), "<[^>]+>", "\n")
    lines = _table(spark, folder, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.split(marked, "\n")).alias("block_no", "raw"))
    blocks = lines.withColumn("text", tx.clean_text(F.col("raw"))).where("text <> ''")
    return chunking.group_sections(blocks.withColumn("is_heading", chunking.is_heading(F.col("text"), F.lit(None).cast("string"))))


@query(rf"""WITH l AS (SELECT conv_id AS doc, turn AS seq, CASE WHEN role = 'user' THEN 'Q' || CAST(turn % 90 + 1 AS VARCHAR) || '. ' || {q.space('text')} ELSE {q.space('text')} END AS line FROM conversations WHERE text IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN regexp_matches(line, '(?i)^Q\s*\d{{1,2}}\.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY seq) AS entry FROM l WHERE line <> ''),
e AS (SELECT doc, entry, string_agg(line, ' ' ORDER BY seq) AS text FROM i WHERE entry > 0 GROUP BY doc, entry),
t AS (SELECT doc, entry, regexp_extract(text, '(?i)^Q\s*(\d{{1,2}})\.\s*(.+)$', 1) AS section_no, {q.heading_title("regexp_extract(text, '(?i)^Q\\s*(\\d{1,2})\\.\\s*(.+)$', 2)")} AS title FROM e)
SELECT doc, section_no, arg_max(title, entry) AS title FROM t WHERE length(title) >= 4 AND section_no <> '' GROUP BY doc, section_no""")
def toc_map(spark: SparkSession, folder: str) -> DataFrame:
    t = tx.normalize_space(F.col("text"))
    lines = _table(spark, folder, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", F.concat(F.lit("Q"), (F.col("turn") % 90 + 1).cast("string"), F.lit(". "), t)).otherwise(t).alias("line"))
    return chunking.contents_map(lines)


# Index and retrieval.


@query(f"WITH {q.BLOCKS}, t AS (SELECT chunk_index, {q.tokens('text')} AS toks FROM blocks) SELECT term, chunk_index, count(*) AS tf, CAST(len(any_value(toks)) AS INTEGER) AS dl FROM (SELECT chunk_index, toks, unnest(toks) AS term FROM t) GROUP BY term, chunk_index")
def tokenize_tf(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.postings(_blocks(spark, folder)).select("term", "chunk_index", "tf", "dl")


@query(f"WITH {q.BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.term_weights(_documents(spark, folder)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {q.QUESTIONS}, {q.BM25}, {q.bm25_list('questions', CONFIG.bm25_k)} SELECT qid, doc_id AS chunk_index, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM sparse")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    out = retrieval.bm25_top_k(_documents(spark, folder), _questions(spark, folder), CONFIG.bm25_k)
    return out.select("qid", "chunk_index", F.round("score", 6).alias("score"), "rank")


@query(f"WITH vq AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 20 = 0), {q.dense_list('vq', CONFIG.dense_k)} SELECT qid, vec_id AS chunk_index, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM dense")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    out = retrieval.dense_top_k(vectors, vectors.where("chunk_index % 20 = 0").withColumnRenamed("chunk_index", "qid"), CONFIG.dense_k)
    return out.select("qid", "chunk_index", F.round("score", 6).alias("score"), "rank")


_FIRST = f"""{q.QUESTIONS}, {q.BM25}, {q.bm25_list('questions', CONFIG.bm25_k)},
vq AS (SELECT qid, embedding FROM questions JOIN embeddings ON vec_id = qid), {q.dense_list('vq', CONFIG.dense_k)},
lists AS (SELECT qid, doc_id AS chunk_index, rank, 0.0 AS dense, score AS bm25 FROM sparse UNION ALL SELECT qid, vec_id, rank, score, 0.0 FROM dense),
fused AS (SELECT qid, chunk_index, sum(1.0 / ({CONFIG.rrf_k} + rank)) AS rrf, sum(dense) AS dense, sum(bm25) AS bm25 FROM lists GROUP BY qid, chunk_index),
first_stage AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, chunk_index) AS rank FROM fused) WHERE rank <= {CONFIG.candidate_k})"""


@query(f"WITH {_FIRST} SELECT qid, chunk_index, round(rrf, 6) AS rrf_score, round(dense, 6) AS dense_score, round(bm25, 6) AS bm25_score, CAST(rank AS INTEGER) AS rank FROM first_stage")
def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    out = retrieval.first_stage(_documents(spark, folder), _vectors(spark, folder), _asked(spark, folder), CONFIG.dense_k, CONFIG.bm25_k, CONFIG.rrf_k, CONFIG.candidate_k)
    return out.select("qid", "chunk_index", *[F.round(c, 6).alias(c) for c in ("rrf_score", "dense_score", "bm25_score")], "rank")


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    """Two queries for each question, the whole and its first six words, merged; with anchors: a document's first line."""
    asked = _questions(spark, folder)
    half = asked.select("qid", F.array_join(F.slice(F.split("query", " "), 1, 6), " ").alias("query"))
    both = asked.select((F.col("qid") * 10).alias("qid"), "query").unionByName(half.select((F.col("qid") * 10 + 1).alias("qid"), "query"))
    found = retrieval.bm25_top_k(_documents(spark, folder), both, CONFIG.bm25_k)
    found = found.select(F.floor(F.col("qid") / 10).alias("question_id"), (F.col("qid") % 10).alias("query_no"), "chunk_index", (1.0 / (CONFIG.rrf_k + F.col("rank"))).alias("rrf_score"), F.lit(0.0).alias("dense_score"), F.col("score").alias("bm25_score"))
    return retrieval.merge_queries(found)


_MERGED = f"""{q.QUESTIONS}, both_q AS (SELECT qid * 10 AS qid, query FROM questions UNION ALL SELECT qid * 10 + 1, array_to_string(list_slice(string_split(query, ' '), 1, 6), ' ') FROM questions), {q.BM25}, {q.bm25_list('both_q', CONFIG.bm25_k)},
merged AS (SELECT qid // 10 AS question_id, doc_id AS chunk_index, sum(1.0 / ({CONFIG.rrf_k} + rank)) AS rrf, max(score) AS bm25, list(qid % 10 ORDER BY qid) AS queries, count(*) AS support, sum(1.0 / ({CONFIG.rrf_k} + rank)) + 0.01 * count(*) AS merge_score FROM sparse GROUP BY qid // 10, doc_id)"""


@query(f"WITH {_MERGED} SELECT question_id, chunk_index, round(rrf, 6) AS aggregate_rrf_score, round(bm25, 6) AS bm25_score, CAST(queries AS VARCHAR) AS queries, support AS query_support_count, round(merge_score, 6) AS merge_score FROM merged")
def multi_query_merge(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.concat(F.lit("["), F.array_join(F.col("retrieval_queries").cast("array<string>"), ", "), F.lit("]"))
    return _merged(spark, folder).select("question_id", "chunk_index", F.round("aggregate_rrf_score", 6).alias("aggregate_rrf_score"), F.round("bm25_score", 6).alias("bm25_score"), shown.alias("queries"), "query_support_count", F.round("merge_score", 6).alias("merge_score"))


def _anchored(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).withColumn("anchor", tx.normalize_space(F.element_at(F.split("text", "\n"), 1)))
    asked = _questions(spark, folder).select(F.col("qid").alias("question_id"), F.col("query").alias("question"))
    rows = _merged(spark, folder).join(docs, "chunk_index").join(F.broadcast(asked) if asked.count() <= 10_000 else asked, "question_id")
    return rows.withColumn("anchor_score", tx.anchor_relevance(F.col("question"), F.col("anchor"))).withColumn("polarity", tx.polarity(F.col("question"), F.col("text")))


_A, _B = f"list_distinct({q.tokens('query', 2)})", f"list_distinct({q.tokens('anchor', 2)})"
_ANCHORED = f"""{_MERGED},
lined AS (SELECT m.*, qs.query, d.text, {q.space('string_split(d.text, chr(10))[1]')} AS anchor FROM merged m JOIN questions qs ON qs.qid = m.question_id JOIN documents d ON d.doc_id = m.chunk_index),
anchored AS (SELECT *, CASE WHEN anchor = '' THEN 0.0 ELSE 0.55 * {q.overlap('query', 'anchor')} + 0.45 * len(list_intersect({_A}, {_B}))::DOUBLE / greatest(len(list_distinct(list_concat({_A}, {_B}))), 1) END AS anchor_score FROM lined),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(merge_score, 9) DESC, chunk_index) AS mp, row_number() OVER (PARTITION BY question_id ORDER BY round(anchor_score, 9) DESC, round(merge_score, 9) DESC, chunk_index) AS ap FROM anchored),
classed AS (SELECT *, CASE WHEN mp <= 32 THEN 0 WHEN anchor_score > 0 THEN 1 ELSE 2 END AS pool_class FROM placed),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pool_class, CASE WHEN pool_class = 1 THEN ap ELSE mp END) AS pool_pos FROM classed) WHERE pool_pos <= 40)"""


@query(f"WITH {_ANCHORED} SELECT question_id, chunk_index, round(anchor_score, 6) AS anchor_score, pool_class, CAST(pool_pos AS INTEGER) AS pool_pos FROM pool")
def rerank_pool(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.rerank_pool(_anchored(spark, folder), CONFIG.rerank_pool_k).select("question_id", "chunk_index", F.round("anchor_score", 6).alias("anchor_score"), "pool_class", "pool_pos")


@query(f"""WITH {_ANCHORED}, s AS (SELECT question_id, chunk_index, {q.overlap('query', 'text')} + 0.55 * anchor_score + {q.polarity('query', 'text')} AS score FROM pool)
SELECT question_id, chunk_index, round(score, 6) AS structured_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_index) AS rank FROM s) WHERE rank <= {CONFIG.top_k}""")
def structured_rerank(spark: SparkSession, folder: str) -> DataFrame:
    pool = retrieval.lexical_rerank(retrieval.rerank_pool(_anchored(spark, folder), CONFIG.rerank_pool_k))
    return retrieval.structured_rerank(pool, CONFIG.top_k).select("question_id", "chunk_index", F.round("structured_score", 6).alias("structured_score"), "rank")


# Context. Hits: every block that begins with a capital T, ranked within its page.


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    blocks = _blocks(spark, folder)
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.length("text").desc(), "chunk_index"))
    return blocks.where(F.col("text").startswith("T")).select(F.col("page").alias("qid"), "chunk_index", rank.alias("rank"), F.when(F.col("block_no") > 0, F.col("page") * (1 << 32)).alias("parent_index"))


_HITS = f"""{q.BLOCKS}, hits AS (SELECT page AS qid, chunk_index, row_number() OVER (PARTITION BY page ORDER BY length(text) DESC, chunk_index) AS rank, CASE WHEN block_no > 0 THEN page * 4294967296 END AS parent_index FROM blocks WHERE starts_with(text, 'T'))"""


@query(f"""WITH {_HITS} SELECT qid, chunk_index, CAST(rank AS INTEGER) AS rank, chunk_index AS expanded_from, 'retrieved' AS context_type FROM hits UNION ALL
SELECT qid, parent_index, CAST(min(rank) AS INTEGER), arg_min(chunk_index, rank), 'parent_section' FROM hits h WHERE parent_index IN (SELECT chunk_index FROM blocks) AND NOT EXISTS (SELECT 1 FROM hits o WHERE o.qid = h.qid AND o.chunk_index = h.parent_index) GROUP BY qid, parent_index""")
def parent_expand(spark: SparkSession, folder: str) -> DataFrame:
    return context.add_parents(_hits(spark, folder), _blocks(spark, folder))


@query(f"""WITH {_HITS}, p AS (SELECT qid, rank, chunk_index, page, block_no FROM hits JOIN blocks USING (chunk_index)),
e AS (SELECT qid, rank, chunk_index, page, block_no, chunk_index AS expanded_from, 'retrieved' AS context_type FROM p UNION ALL
      SELECT p.qid, p.rank, b.chunk_index, b.page, b.block_no, p.chunk_index, 'neighbor' FROM p JOIN blocks b ON b.page = p.page AND b.block_no BETWEEN p.block_no - 2 AND p.block_no + 2),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY qid, chunk_index ORDER BY context_type DESC, rank, expanded_from) = 1)
SELECT qid, CAST(rank AS INTEGER) AS rank, chunk_index, expanded_from, context_type, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, page, block_no, chunk_index) AS position FROM f) WHERE position <= {CONFIG.max_context_chunks}""")
def neighbor_expand(spark: SparkSession, folder: str) -> DataFrame:
    out = context.expand_neighbors(_hits(spark, folder), _blocks(spark, folder).select("chunk_index", "page", "block_no"), CONFIG.expand_window, CONFIG.max_context_chunks)
    return out.select("qid", "rank", "chunk_index", "expanded_from", "context_type", "position")


# Text functions over all blocks, and over all pairs of question and answer.


@query(f"WITH {q.BLOCKS} SELECT chunk_index, round({q.list_signal('text')}, 6) AS list_signal, {q.estimate('text')} AS tokens, {q.clean_unit('text')} AS clean_unit, {q.canonical('text')} AS canonical FROM blocks")
def unit_texts(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _blocks(spark, folder).select("chunk_index", F.round(tx.list_signal(t), 6).alias("list_signal"), tx.token_estimate(t).alias("tokens"), tx.clean_unit(t).alias("clean_unit"), tx.canonical(t).alias("canonical"))


_VISIBLE = rf"greatest(length(regexp_replace({q.space('text')}, '\s', '', 'g')), 1)"


@query(rf"""WITH {q.BLOCKS} SELECT chunk_index, round({q.noise('text')}, 6) AS noise,
round(CASE WHEN length({q.space('text')}) = 0 THEN 0.0 ELSE greatest(0.0, {q.count(q.space('text'), '[가-힣a-zA-Z0-9]')}::DOUBLE / {_VISIBLE} - {q.noise(q.space('text'))} - CASE WHEN length({q.space('text')}) > 700 THEN 0.4 WHEN length({q.space('text')}) > 300 THEN 0.15 ELSE 0.0 END) END, 6) AS quality,
length({q.space('text')}) = 0 OR (length({q.space('text')}) > 600 AND {q.noise(q.space('text'))} > 0.16) OR {q.noise(q.space('text'))} >= 0.28 OR (length({q.space('text')}) > 250 AND {q.count(q.space('text'), r'[<>{}\[\]=_/\\|]')}::DOUBLE / length({q.space('text')}) > 0.035) AS noisy
FROM blocks""")
def noise_metrics(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _blocks(spark, folder).select("chunk_index", F.round(tx.noise_ratio(t), 6).alias("noise"), F.round(tx.ocr_quality(t), 6).alias("quality"), tx.is_noisy(t).alias("noisy"))


@query(f"WITH {q.PAIRS} SELECT conv_id, turn, {q.intent('question')} AS question_intent, {q.intent('answer')} AS answer_intent, round({q.overlap('question', 'answer')}, 6) AS overlap FROM pairs")
def intent_overlap(spark: SparkSession, folder: str) -> DataFrame:
    p = _pairs(spark, folder)
    return p.select("conv_id", "turn", tx.intent(F.col("question")).alias("question_intent"), tx.intent(F.col("answer")).alias("answer_intent"), F.round(tx.query_overlap(F.col("question"), F.col("answer")), 6).alias("overlap"))


_GA, _GB = (f"list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))" for x in ("a", "b"))


@query(f"""WITH {q.PAIRS}, c AS (SELECT conv_id, turn, {q.canonical('question')} AS a, {q.canonical('answer')} AS b FROM pairs),
g AS (SELECT *, CASE WHEN length(a) < 2 THEN [a] ELSE {_GA} END AS ga, CASE WHEN length(b) < 2 THEN [b] ELSE {_GB} END AS gb FROM c)
SELECT conv_id, turn, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN contains(a, b) OR contains(b, a) THEN 1.0 ELSE len(list_intersect(ga, gb))::DOUBLE / len(list_distinct(list_concat(ga, gb))) END, 6) AS similarity FROM g""")
def bigram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("conv_id", "turn", F.round(tx.bigram_similarity(F.col("question"), F.col("answer")), 6).alias("similarity"))


# Korean fixtures, as the rules are about Korean wording.

FIXTURE_QUESTIONS = (
    (1, "조회 가능한 이용 경로를 모두 나열하세요."),
    (2, "어떤 앱을 설치해야 하나요?"),
    (3, "어떻게 변경하나요?"),
    (4, "개인통관고유부호는 무엇인가요?"),
    (5, "안녕하세요"),
    (6, "두 가지 이상 나열"),
    (7, "3개 이상 종류를 알려 주세요."),
    (8, "24시간 즉시 발급 가능 여부와 재발급 방법, 그리고 조회 절차를 설명하세요."),
    (9, "휴대전화가 없을 때 조회할 수 있나요?"),
)

FIXTURE_ANSWERS = (
    "인증방법: 휴대폰인증, 간편인증, 휴대폰인증",
    "신청한 즉시 조회 가능합니다. 24시간 이용할 수 있습니다.",
    "불가합니다. 휴대전화가 없는 경우 안 됩니다.",
    "개인통관고유부호란 수입 통관을 위한 부호를 말합니다.",
    "① 로그인 후 메뉴에서 ② 변경 버튼을 선택하여 신청합니다. https://example.org",
    "A, B, C: (x)",
    "{}[]<>~~ ^^ 1234567 99999999 www",
    "없음",
)


def _fixtures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FIXTURE_QUESTIONS), "question_id long, question string")


_FIX = "fix(question_id, question) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in FIXTURE_QUESTIONS) + ")"


#: Questions of every kind, made of the fixtures and the user's turns, with answers in every kind of wording.
def _asked_pairs(spark: SparkSession, folder: str) -> DataFrame:
    fixtures = spark.createDataFrame([(i, t, a) for i, t in FIXTURE_QUESTIONS for a in FIXTURE_ANSWERS], "id long, question string, answer string")
    pairs = _pairs(spark, folder).select((F.col("conv_id") * 1000 + F.col("turn") + 100).alias("id"), "question", "answer")
    rows = pairs.unionByName(fixtures).withColumn("kind", F.when(F.length("answer") % 3 == 2, "ocr").otherwise("text"))
    return rows.distinct()


def _asked_sql() -> str:
    answers = ", ".join(f"('{x}')" for x in FIXTURE_ANSWERS)
    return f"""{q.PAIRS}, {_FIX}, said(answer) AS (VALUES {answers}), ap AS (SELECT *, CASE WHEN length(answer) % 3 = 2 THEN 'ocr' ELSE 'text' END AS kind FROM (
  SELECT DISTINCT conv_id * 1000 + turn + 100 AS id, question, answer FROM pairs UNION SELECT question_id, question, answer FROM fix, said))"""


@query(f"""WITH {_asked_sql()} SELECT id, answer, round(4.0 * {q.overlap('question', 'answer')} + 0.2 * (id % 5) + 1.5 * 0.02
+ CASE WHEN kind = 'ocr' THEN -2.2 - CASE WHEN length(answer) > 300 THEN 1.5 ELSE 0.0 END - CASE WHEN length(answer) > 800 THEN 2.0 ELSE 0.0 END - {q.noise('answer')} * 2.0 - CASE WHEN {q.noisy('answer')} THEN 2.0 ELSE 0.0 END ELSE 0.0 END
+ {q.unit_bonus('question', 'answer')} + CASE WHEN length(answer) >= 25 THEN 0.15 ELSE 0.0 END - CASE WHEN length(answer) > 1200 THEN 0.4 ELSE 0.0 END - (id % 7) * 0.015, 6) AS score FROM ap""")
def unit_base_score(spark: SparkSession, folder: str) -> DataFrame:
    p = _asked_pairs(spark, folder)
    return p.select("id", "answer", F.round(tx.unit_score(F.col("question"), F.col("answer"), F.col("kind"), (F.col("id") % 5).cast("double"), F.lit(0.02), F.col("id") % 7), 6).alias("score"))


@query(f"""WITH {_asked_sql()}, t AS (SELECT *, {q.critical('question')} AS terms, {q.intent('question')} = 'list' AS listed, {q.requested('question')} AS wanted, {q.n_items('answer')} AS n_items,
len(list_filter(list_transform(regexp_split_to_array({q.space('answer')}, '[,，、]'), lambda x: {q.space('x')}), lambda x: x NOT IN ('', '등', '없음'))) AS n_pieces FROM ap),
m AS (SELECT *, len(list_filter(terms, lambda t: NOT contains({q.norm(q.space('answer'))}, {q.norm('t')}))) AS n_missing, CASE WHEN listed THEN coalesce(wanted, 2) ELSE coalesce(wanted, 0) END AS required, CASE WHEN NOT listed THEN 0 WHEN n_items > 0 THEN n_items ELSE n_pieces END AS shown FROM t)
SELECT id, answer, CAST(n_missing AS INTEGER) AS n_missing, CAST(required AS INTEGER) AS required, CAST(shown AS INTEGER) AS shown, {q.polarity('question', 'answer')} AS polarity,
n_missing = 0 AND NOT (listed AND shown < required) AS ok, CASE WHEN listed AND shown < required THEN 'not_enough_list_items' WHEN n_missing > 0 THEN 'missing_critical_terms' ELSE 'ok' END AS reason FROM m""")
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    out = units.coverage(_asked_pairs(spark, folder).withColumn("final_answer", F.col("answer")))
    return out.select("id", "answer", F.size("missing_terms").alias("n_missing"), F.col("required_min_items").alias("required"), F.col("rendered_item_count").alias("shown"), tx.polarity(F.col("question"), F.col("answer")).alias("polarity"), "ok", "reason")


@query(rf"""WITH {q.PAIRS}, l AS (SELECT conv_id, turn, unnest(string_split(answer, chr(10))) AS raw, generate_subscripts(string_split(answer, chr(10)), 1) AS line_no FROM pairs),
c AS (SELECT conv_id, turn, line_no, {q.clean('raw')} AS line FROM l WHERE {q.clean('raw')} <> ''),
s AS (SELECT *, regexp_matches(line, '^\s*(?:[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]|\d+[\.)]|[‣∎•○●※*\-])\s*') OR (regexp_matches(line, '^\s*[A-Z]?[\[\(]?.{{0,12}}[:：]') AND length(line) < 600 AND row_number() OVER (PARTITION BY conv_id, turn ORDER BY line_no) > 1) AS starts FROM c),
g AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY conv_id, turn ORDER BY line_no) AS grp FROM s),
u AS (SELECT conv_id, turn, grp, {q.space("string_agg(line, ' ' ORDER BY line_no)")} AS unit FROM g GROUP BY conv_id, turn, grp),
r AS (SELECT conv_id, turn, grp, CASE WHEN length(unit) > 1500 AND NOT ({q.list_signal('unit')} >= 1.2 OR regexp_matches(unit, ',|，|http')) THEN unit ELSE rtrim(substr(unit, 1, 1500)) END AS unit FROM u),
f AS (SELECT conv_id, turn, unit, min(grp) AS pos FROM r WHERE unit <> '' GROUP BY conv_id, turn, unit)
SELECT conv_id * 1000 + turn AS id, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS INTEGER) AS unit_no, unit FROM f""")
def answer_units(spark: SparkSession, folder: str) -> DataFrame:
    p = _pairs(spark, folder).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "answer")
    return units.answer_units(p, "id", "answer", CONFIG.max_chars_per_answer_unit)


@query(rf"""WITH {_FIX}, n AS (SELECT *, {q.space('question')} AS s FROM fix)
SELECT question_id, {q.intent('question')} AS intent, array_to_string({q.tokens('question')}, ' ') AS tokens,
{q.requested('question')} AS requested,
regexp_matches(s, '없(?:는|을|어|습니다|나요|다면)?|아니|안\s*되|못\s*하|불가|제한') AS negative FROM n""")
def question_rules(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("question")
    return _fixtures(spark).select("question_id", tx.intent(t).alias("intent"), F.array_join(tx.tokenize(t), " ").alias("tokens"), tx.requested_count(t).alias("requested"), tx.contains_negation(t).alias("negative"))


@query(rf"""WITH {_FIX}, asked AS (SELECT question_id, question FROM fix UNION ALL SELECT conv_id * 1000 + turn + 100, text FROM conversations WHERE role = 'user' AND text IS NOT NULL),
n AS (SELECT question_id, {q.space('question')} AS q FROM asked),
p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(q, '(?:알려\s*주세요|답(?:하|해)세요|나열(?:하|해)세요|설명(?:하|해)세요)[?.!]*$', '')), '\s*(?:그리고|또한|및|와|과|,|;|/|\?|\.)\s*'), lambda x: {q.space('x')}), lambda x: length(x) >= 4) AS parts FROM n),
k AS (SELECT *, list_transform(parts, lambda x: {q.norm('x')}) AS keys FROM p),
d AS (SELECT *, list_slice(list_filter(parts, lambda x, i: keys[i] <> '' AND list_position(keys, keys[i]) = i), 1, 6) AS reqs FROM k)
SELECT question_id, {q.intent('q')} AS answer_style, array_to_string(list_transform(reqs, lambda x: x || '=' || {q.intent('x')}), '|') AS requirements,
array_to_string(list_slice(list_concat([q], list_filter(reqs, lambda x: {q.norm('x')} <> {q.norm('q')} AND x <> q)), 1, 3), '|') AS queries,
regexp_matches(q, '모두|전부|각각|나열|전체|가능한|방법들|경로들') OR len(reqs) > 1 AS comprehensive FROM d""")
def plan_heuristic(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").where("role = 'user' AND text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn") + 100).alias("question_id"), F.col("text").alias("question"))
    plans = planning.plan_questions(_fixtures(spark).unionByName(turns), max_queries=CONFIG.num_retrieval_queries, max_requirements=CONFIG.max_question_requirements)
    return plans.select("question_id", "answer_style", F.array_join(F.transform("requirements", lambda r: F.concat(r["requirement"], F.lit("="), r["type"])), "|").alias("requirements"), F.array_join("retrieval_queries", "|").alias("queries"), "comprehensive")


_SPECS = ((1, "p.4-8"), (2, "섹션 3, p.4-8, 분할 0"), (3, "p. 12 ~ p. 15"), (4, "9-3"), (5, "없음"))


@query("SELECT * FROM (VALUES (1, '4,5,6,7,8'), (2, '0,3,4,5,6,7,8'), (3, '12,13,14,15'), (4, ''), (5, '')) v(id, pages)")
def page_spec(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame(list(_SPECS), "id int, spec string")
    return rows.select("id", F.array_join(tx.page_spec(F.col("spec")).cast("array<string>"), ",").alias("pages"))


@query("SELECT event_id, props AS object FROM events WHERE props IS NOT NULL")
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "events").where("props IS NOT NULL").select("event_id", F.concat(F.lit("the answer is: "), "props", F.lit(" as asked")).alias("reply"))
    return rows.select("event_id", tx.json_object(F.col("reply")).alias("object"))


# Selection, evidence and evaluation over pairs of question and answer.


def _pair_units(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of each answer as units of its question; every third one as if read by OCR."""
    p = _pairs(spark, folder).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "question", F.posexplode(F.split("answer", r"\.")).alias("unit_no", "raw"))
    rows = p.withColumn("text", tx.normalize_space(F.col("raw"))).where("text <> ''")
    return rows.select("qid", "question", F.col("unit_no").cast("long").alias("unit_no"), F.when(F.col("unit_no") % 3 == 2, "ocr").otherwise("text").alias("kind"), F.lit("body").alias("role"), "text", F.round(tx.query_overlap(F.col("question"), F.col("text")) * 4 - F.col("unit_no") * 0.015, 6).alias("score"))


_PAIR_UNITS = f"""{q.PAIRS}, cut AS (SELECT conv_id * 1000 + turn AS qid, question, unnest(string_split(answer, '.')) AS raw, generate_subscripts(string_split(answer, '.'), 1) - 1 AS unit_no FROM pairs),
pu AS (SELECT qid, question, unit_no, CASE WHEN unit_no % 3 = 2 THEN 'ocr' ELSE 'text' END AS kind, {q.space('raw')} AS text FROM cut WHERE {q.space('raw')} <> '')"""


@query(f"""WITH {_PAIR_UNITS}, o AS (SELECT *, CASE WHEN kind = 'text' THEN 0.0 ELSE 1.0 END AS dirty, round({q.list_signal('text')}, 9) AS signal, round({q.overlap('question', 'text')}, 9) AS ov, length({q.clean_unit('text')}) AS n, {q.intent('question')} AS style FROM pu),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN style IN ('list', 'availability') THEN dirty ELSE 0 END, CASE WHEN style = 'list' THEN -signal ELSE 0 END, CASE WHEN style IN ('list', 'availability') THEN -ov ELSE 0 END, CASE WHEN style IN ('list', 'availability') THEN n ELSE 0 END, unit_no) AS place FROM o)
SELECT qid, unit_no, text, style AS answer_style, CAST(place AS INTEGER) AS place FROM r WHERE place <= CASE WHEN style IN ('list', 'availability') THEN 1 WHEN style = 'procedure' THEN 6 ELSE 2 END""")
def choose_units(spark: SparkSession, folder: str) -> DataFrame:
    return units.choose_units(_pair_units(spark, folder)).select("qid", "unit_no", "text", "answer_style", "place")


@query(f"""WITH {_PAIR_UNITS}, c AS (SELECT qid, question, unit_no, text FROM pu WHERE {q.intent('question')} NOT IN ('list', 'availability') QUALIFY row_number() OVER (PARTITION BY qid ORDER BY unit_no) <= CASE WHEN {q.intent('question')} = 'procedure' THEN 6 ELSE 2 END)
SELECT qid, {q.space("string_agg(" + q.clean_unit('text') + ", ' ' ORDER BY unit_no)")} AS final_answer, 'unit_extract' AS mode, CAST(count(*) AS INTEGER) AS n_quotes FROM c GROUP BY qid
UNION ALL SELECT 1000000007, 'a b c, d e', 'label_value_list', 1""")
def render_answer(spark: SparkSession, folder: str) -> DataFrame:
    """Answers rendered from chosen units; with them a list question, as the conversations have none."""
    listed = spark.createDataFrame([(1000000007, FIXTURE_QUESTIONS[0][1], 1, "label: a  b c, d e, a b c")], "qid long, question string, place int, text string")
    chosen = units.choose_units(_pair_units(spark, folder)).where(~F.col("answer_style").isin("list", "availability"))
    out = units.render_answers(chosen.select("qid", "question", "place", "text").unionByName(listed))
    return out.select("qid", "final_answer", "mode", F.size("quotes").alias("n_quotes"))


def _mixed_units(spark: SparkSession, folder: str) -> DataFrame:
    """The units of the pairs, and of the fixtures: every answer as a unit of every question, every third one as if read by OCR."""
    rows = [(i, t, n, "ocr" if n % 3 == 2 else "text", a) for i, t in FIXTURE_QUESTIONS for n, a in enumerate(FIXTURE_ANSWERS) if (i + n) % 4]
    fixtures = spark.createDataFrame(rows, "qid long, question string, unit_no long, kind string, text string")
    return _pair_units(spark, folder).select("qid", "question", "unit_no", "kind", "text").unionByName(fixtures)


_MIXED = f"""{_PAIR_UNITS}, {_FIX}, said(n, answer) AS (VALUES {", ".join(f"({n}, '{a}')" for n, a in enumerate(FIXTURE_ANSWERS))}),
mu AS (SELECT qid, question, unit_no, kind, text FROM pu UNION ALL SELECT question_id, question, n, CASE WHEN n % 3 = 2 THEN 'ocr' ELSE 'text' END, answer FROM fix, said WHERE (question_id + n) % 4 <> 0)"""


@query(f"""WITH {_MIXED}, n AS (SELECT *, kind = 'ocr' AND {q.noisy('text')} AS noisy FROM mu),
w AS (SELECT *, bool_or(kind = 'text') OVER (PARTITION BY qid) AS hc, bool_or(noisy) OVER (PARTITION BY qid) AS hn FROM n),
k AS (SELECT *, bool_or(kind = 'ocr') OVER (PARTITION BY qid) AS ho, {q.critical('question')} AS terms, kind = 'text' AND {q.n_items('text')} >= coalesce({q.requested('question')}, 2) AS li,
  kind = 'text' AND {q.overlap('question', 'text')} > 0 AS ov FROM w WHERE NOT (noisy AND hc)),
c AS (SELECT *, kind = 'text' AND len(terms) > 0 AND len(list_filter(terms, lambda t: NOT contains({q.norm('text')}, {q.norm('t')}))) = 0 AS co FROM k),
a AS (SELECT *, bool_or(li) OVER (PARTITION BY qid) AS al, bool_or(co) OVER (PARTITION BY qid) AS ac, bool_or(ov) OVER (PARTITION BY qid) AS ao FROM c),
r AS (SELECT *, CASE WHEN NOT ho THEN CASE WHEN hn AND hc THEN 'dropped_noisy_ocr_units' ELSE 'no_ocr_selected' END WHEN NOT hc THEN 'ocr_only'
  WHEN {q.intent('question')} = 'list' THEN CASE WHEN al THEN 'clean_list_unit_available' ELSE 'no_clean_list_unit' END
  WHEN ac THEN 'clean_unit_covers_critical_terms' WHEN ao THEN 'clean_unit_has_query_overlap' ELSE 'no_clean_replacement' END AS clean_reason FROM a)
SELECT qid, unit_no, kind, clean_reason FROM r WHERE CASE clean_reason WHEN 'clean_list_unit_available' THEN li WHEN 'clean_unit_covers_critical_terms' THEN co WHEN 'clean_unit_has_query_overlap' THEN ov ELSE true END""")
def prefer_clean(spark: SparkSession, folder: str) -> DataFrame:
    return units.prefer_clean(_mixed_units(spark, folder)).select("qid", "unit_no", "kind", "clean_reason")


@query()
def fuzzy_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return units.dedupe_units(_pair_units(spark, folder)).select("qid", "unit_no", "kind", "text")


@query(f"""WITH {_PAIR_UNITS}, t AS (SELECT qid, unit_no + 1 AS rank, sum({q.estimate('text')}) OVER (PARTITION BY qid ORDER BY unit_no) AS total FROM pu) SELECT qid, rank, CAST(total AS BIGINT) AS tokens_to_here FROM t WHERE total <= 200 OR rank <= 3""")
def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return units.within_budget(_pair_units(spark, folder).withColumn("rank", F.col("unit_no") + 1), 200).select("qid", "rank", "tokens_to_here")


@query(f"""WITH {_PAIR_UNITS}, i AS (SELECT qid, 2 AS source_priority, unit_no AS source_pos, unit_no // 4 AS source_chunk_id, text FROM pu UNION ALL SELECT qid, 1, unit_no, unit_no // 4, text FROM pu WHERE unit_no < 2),
d AS (SELECT *, row_number() OVER (PARTITION BY qid, source_chunk_id, substr({q.canonical('text')}, 1, 160) ORDER BY source_priority, source_pos) AS n FROM i),
e AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source_priority, source_pos, source_chunk_id) AS evidence_no FROM d WHERE n = 1)
SELECT qid, source_priority, source_pos, source_chunk_id, CAST(evidence_no AS INTEGER) AS evidence_no FROM e WHERE evidence_no <= {CONFIG.max_composer_evidence}""")
def evidence_union(spark: SparkSession, folder: str) -> DataFrame:
    return _evidence(spark, folder).select("qid", "source_priority", "source_pos", "source_chunk_id", "evidence_no")


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    u = _pair_units(spark, folder).select("qid", "question", F.col("unit_no").alias("source_pos"), F.floor(F.col("unit_no") / 4).alias("source_chunk_id"), "text", F.col("kind").alias("source_kind"))
    return evidence.unite_evidence(u.withColumn("source_priority", F.lit(2)).unionByName(u.where("source_pos < 2").withColumn("source_priority", F.lit(1))), CONFIG.max_composer_evidence)


@query()
def requirement_map(spark: SparkSession, folder: str) -> DataFrame:
    asked = _pairs(spark, folder).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "question")
    plans = planning.plan_questions(asked, max_requirements=CONFIG.max_question_requirements)
    wanted = plans.select("qid", "question", F.posexplode("requirements").alias("requirement_no", "r")).select("qid", "question", (F.col("requirement_no") + 1).cast("long").alias("requirement_no"), F.col("r.requirement").alias("requirement"))
    return evidence.map_requirements(evidence.requirement_scores(wanted, _evidence(spark, folder).drop("question")))


@query()
def budget_cut(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.fit_budget(_evidence(spark, folder), 120).select("qid", "evidence_no", "tokens_to_here", F.length("text").alias("chars"))


@query()
def seed_answer(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.seed_answers(_pair_units(spark, folder)).select("qid", "final_answer")


def _detail(spark: SparkSession, folder: str) -> DataFrame:
    """Each question's tokens as requirements; two versions of answers: whole, and without their last half."""
    p = _pairs(spark, folder)
    wanted = F.slice(F.array_distinct(tx.tokenize(F.col("question"), 2)), 1, 5)
    cases = p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.transform(wanted, lambda t: F.struct(t.alias("label"), F.array(t).alias("aliases"))).alias("answer_requirements"), F.transform(wanted, lambda t: F.struct(F.array(F.col("turn").cast("int")).alias("pages"), F.array(t).alias("aliases"))).alias("evidence_requirements"))
    found = lambda text: F.array(F.struct(text.alias("quote"), F.lit("").alias("title"), F.concat(F.lit("p."), F.col("turn").cast("string")).alias("page"), F.lit("").alias("locator")))
    half = F.substr("answer", F.lit(1), F.floor(F.length("answer") / 2).cast("int"))
    version = lambda name, text: p.select(F.lit(name).alias("version"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit(1).alias("seq"), text.alias("answer"), found(text).alias("evidence"), (F.length(text) / 1000).alias("seconds"))
    return evaluation.evaluate(cases, version("base", F.col("answer")).unionByName(version("half", half)))


_WANTED = "w AS (SELECT conv_id * 1000 + turn AS id, list_slice(list_transform(list_filter(list_zip(toks, range(1, len(toks) + 1)), lambda z: list_position(toks, z[1]) = z[2]), lambda z: z[1]), 1, 5) AS wanted, answer FROM (SELECT *, " + q.tokens("question", 2) + " AS toks FROM pairs))"
_NORMED = f"replace({q.answer_norm('answer')}, ' ', '')"
_DETAIL = f"""{q.PAIRS}, {_WANTED}, v AS (SELECT 'base' AS version, id, wanted, answer FROM w UNION ALL SELECT 'half', id, wanted, substr(answer, 1, length(answer) // 2) FROM w),
d AS (SELECT version, id, answer, round(CASE WHEN len(wanted) = 0 THEN 0.0 ELSE len(list_filter(wanted, lambda t: contains({_NORMED}, t)))::DOUBLE / len(wanted) * 100.0 END, 2) AS pct, round(length(answer) / 1000.0, 3) AS sec FROM v)"""


@query(f"WITH {_DETAIL} SELECT version, id, pct AS answer_completeness_pct, pct AS evidence_hit_rate_pct, sec AS response_time_sec FROM d")
def answer_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _detail(spark, folder).select("version", "id", "answer_completeness_pct", "evidence_hit_rate_pct", "response_time_sec")


@query(f"WITH {_DETAIL} SELECT version, count(*) AS n_test_cases, count(*) FILTER (trim(answer) <> '') AS n_answered, round(avg(pct), 2) AS mean_answer_completeness_pct, round(median(sec), 3) AS median_response_time_sec FROM d GROUP BY version")
def version_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.summarize(_detail(spark, folder)).select("version", "n_test_cases", "n_answered", "mean_answer_completeness_pct", "median_response_time_sec")


@query(f"WITH {_DETAIL} SELECT b.id, round(h.pct - b.pct, 6) AS delta, CASE WHEN h.pct - b.pct > 0.01 THEN 'improved' WHEN h.pct - b.pct < -0.01 THEN 'regressed' ELSE 'same' END AS verdict FROM d b JOIN d h ON h.id = b.id AND b.version = 'base' AND h.version = 'half'")
def ab_delta(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.compare(_detail(spark, folder), "base", "half").select("id", "delta", "verdict")


@query(f"WITH {_DETAIL} SELECT id AS qid, max(answer) FILTER (version = 'base') AS base, max(answer) FILTER (version = 'half') AS half FROM d GROUP BY id")
def compare_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.compare_pivot(_detail(spark, folder).select(F.col("id").alias("qid"), F.col("version").alias("config"), "answer"), ["base", "half"])


@query(f"WITH {_PAIR_UNITS} SELECT kind, count(*) AS n FROM pu GROUP BY kind")
def kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.kind_counts(_pair_units(spark, folder))


@query(f"WITH {_PAIR_UNITS} SELECT qid, string_agg('[' || (unit_no + 1) || '] p.' || qid || ' ' || kind || ' 0.0000' || chr(10) || substr(text, 1, 700), chr(10) || chr(10) ORDER BY unit_no) AS block FROM pu GROUP BY qid")
def debug_block(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.debug_block(_pair_units(spark, folder).select("qid", (F.col("unit_no") + 1).alias("rank"), F.col("qid").alias("page"), "kind", F.lit(0.0).alias("score"), "text"))


@query()
def end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    """Every question answered: plan, hybrid retrieval, merging, reranking, units (distinct, clean, chosen by the kind of question), rendering and coverage; no parents or neighbours."""
    from gleanery.plans.engine import answer_questions

    return answer_questions(_documents(spark, folder), _vectors(spark, folder), _asked(spark, folder), CONFIG)


# Rules that answers, contexts and reports share, over units, blocks and versions.


@query(rf"""WITH {_PAIR_UNITS} SELECT qid, unit_no, 'passage: ' || text AS passage, {q.garbled('text')} AS garbled,
kind = 'ocr' AND (length({q.space('text')}) > 300 OR {q.noisy('text')} OR {q.garbled('text')}) AS unacceptable,
CASE kind WHEN 'text' THEN 0 ELSE 8 END AS kind_priority, 0 AS role_priority, CAST(length({q.clean_unit('text')}) AS INTEGER) AS unit_length,
CASE WHEN unit_no % 2 = 0 THEN 'p.' || unit_no ELSE 'p.' || unit_no || '-' || (unit_no + 3) END AS page_string, lower(trim(' Yes ')) IN ('true', '1', 'yes', 'y') AND unit_no % 2 = 0 AS flag,
{q.intent('question')} = 'list' AS list_style FROM pu""")
def unit_rules(spark: SparkSession, folder: str) -> DataFrame:
    t, n = F.col("text"), F.col("unit_no")
    order = tx.unit_priority(F.col("kind"), F.col("role"), t, F.col("score"))
    flag = F.when(n % 2 == 0, F.lit(" Yes ")).otherwise(F.lit("no"))
    return _pair_units(spark, folder).select("qid", "unit_no", tx.prefixed(t, "passage").alias("passage"), tx.is_garbled(t).alias("garbled"), tx.is_unacceptable_ocr(F.col("kind"), t).alias("unacceptable"), order["kind"].alias("kind_priority"), order["role"].alias("role_priority"), order["length"].alias("unit_length"), tx.page_string(n, F.when(n % 2 == 0, n).otherwise(n + 3)).alias("page_string"), tx.as_bool(flag).alias("flag"), tx.is_list_style(F.col("question")).alias("list_style"))


_ITEMS = f"list_filter(list_transform(regexp_split_to_array({q.list_payload('text')}, '\\s*,\\s*|，|、'), lambda x: {q.clean_unit('x')}), lambda x: x NOT IN ('', ',', '，', 'ㆍ', '·') AND {q.canonical('x')} <> '')"


@query(f"""WITH {_PAIR_UNITS}, i AS (SELECT qid, unit_no, {q.list_payload('text')} AS payload, {_ITEMS} AS found FROM pu),
k AS (SELECT *, list_transform(found, lambda x: {q.canonical('x')}) AS keys FROM i),
d AS (SELECT *, list_filter(found, lambda x, i: list_position(keys, keys[i]) = i) AS items FROM k)
SELECT qid, unit_no, payload, array_to_string(items, '|') AS items, CASE WHEN len(items) >= 2 THEN array_to_string(list_slice(items, 1, 6), ', ') || CASE WHEN len(items) > 6 THEN ' 등' ELSE '' END ELSE payload END AS answer,
CASE WHEN len(items) >= 2 THEN 'label_value_list' ELSE 'label_value_payload' END AS mode FROM d""")
def render_list(spark: SparkSession, folder: str) -> DataFrame:
    shown = tx.render_list(F.lit("list"), F.col("text"))
    return _pair_units(spark, folder).select("qid", "unit_no", tx.list_payload(F.col("text")).alias("payload"), F.array_join(tx.list_items(F.col("text")), "|").alias("items"), shown["answer"].alias("answer"), shown["mode"].alias("mode"))


@query(f"""WITH {_PAIR_UNITS}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round({q.overlap('question', 'text')}, 9) DESC, length({q.clean_unit('text')}), unit_no) AS place FROM pu WHERE kind = 'ocr')
SELECT qid, unit_no, CAST(place AS INTEGER) AS place, substr({q.clean_unit('text')}, 1, 500) AS quote_preview, round({q.noise('text')}, 6) AS ocr_noise_ratio FROM o WHERE place <= 3""")
def ocr_support(spark: SparkSession, folder: str) -> DataFrame:
    return units.ocr_support(_pair_units(spark, folder)).select("qid", "unit_no", "place", "quote_preview", F.round("ocr_noise_ratio", 6).alias("ocr_noise_ratio"))


@query(f"""WITH {_PAIR_UNITS}, t AS (SELECT qid, question, unit_no, CASE WHEN unit_no % 4 = 3 THEN 'anchor_question' ELSE 'body' END AS role, CASE WHEN unit_no % 5 = 4 THEN text || ' answered' ELSE '' END AS answer_text, text FROM pu)
SELECT qid, unit_no, CASE WHEN answer_text <> '' THEN {q.clean('answer_text')} WHEN role = 'anchor_question' THEN '' ELSE {q.clean('text')} END AS view,
CASE WHEN unit_no % 2 = 0 THEN 'own' WHEN role = 'anchor_question' THEN {q.space('text')} ELSE '' END AS anchor FROM t""")
def answer_view(spark: SparkSession, folder: str) -> DataFrame:
    n, t = F.col("unit_no"), F.col("text")
    role = F.when(n % 4 == 3, "anchor_question").otherwise("body")
    own = F.when(n % 5 == 4, F.concat(t, F.lit(" answered"))).otherwise("")
    return _pair_units(spark, folder).select("qid", "unit_no", tx.answer_view(role, own, t).alias("view"), tx.anchor_of(F.lit("text"), role, F.when(n % 2 == 0, " own "), t).alias("anchor"))


_STRIPPED = f"list_filter(list_transform(string_split(marked, chr(10)), lambda x: {q.clean('x')}), lambda x: x <> '')"
_HEADED = rf"""(regexp_matches(l[1], '(?i)^\s*Q\s*(\d{{1,2}})\.\s*(.+?)\s*(?:[·.․…]+\s*)?(\d{{1,2}})\s*$') OR (regexp_matches({q.space('l[1]')}, '^(\d{{1,2}})\.\s+(.+)$') AND NOT regexp_matches({q.space('l[1]')}, '··|…') AND length({q.space('l[1]')}) <= 140 AND NOT contains({q.heading_title('l[1]')}, '다음과같습니다')))"""


@query(f"""WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '7. ' WHEN 1 THEN 'Q 7. a heading ... 12' || chr(10) ELSE '' END || text AS marked FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, {_STRIPPED} AS l FROM m)
SELECT doc_id, {q.clean("array_to_string(CASE WHEN len(l) > 0 AND " + _HEADED + " THEN list_slice(l, 2, len(l)) ELSE l END, chr(10))")} AS body FROM s""")
def anchor_strip(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").where("text IS NOT NULL")
    mark = F.when(F.col("doc_id") % 3 == 0, "7. ").when(F.col("doc_id") % 3 == 1, "Q 7. a heading ... 12\n").otherwise("")
    return docs.select("doc_id", chunking.strip_anchor_lines(F.concat(mark, "text")).alias("body"))


@query(f"""WITH {q.PAIRS}, r AS (SELECT *, string_split({q.space('question')}, ' ') AS w FROM pairs),
t AS (SELECT *, array_to_string(list_slice(w, 1, 4), ' ') AS r1, array_to_string(list_slice(w, 5, 8), ' ') AS r2 FROM r)
SELECT conv_id, turn, round({q.overlap('question', 'answer')} + 0.7 * {q.overlap('r1', 'answer')} + 0.7 * {q.overlap('r2', 'answer')} + 0.05 * turn + 0.3 * 0.02, 6) AS relevance FROM t""")
def context_relevance(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split(tx.normalize_space(F.col("question")), " ")
    wanted = [F.array_join(F.slice(words, i, 4), " ") for i in (1, 5)]
    return _pairs(spark, folder).select("conv_id", "turn", F.round(evidence.context_relevance(F.col("question"), wanted, F.col("answer"), F.col("turn"), F.lit(0.02)), 6).alias("relevance"))


@query(f"""WITH {q.BLOCKS}, k AS (SELECT *, block_no % 3 = 2 AS ocr FROM blocks), c AS (SELECT page, sum(length(text)) AS chars FROM k WHERE NOT ocr GROUP BY page)
SELECT chunk_index FROM k LEFT JOIN c USING (page) WHERE ocr AND coalesce(chars, 0) < 80""")
def ocr_filter(spark: SparkSession, folder: str) -> DataFrame:
    blocks = _blocks(spark, folder)
    ocr = F.col("block_no") % 3 == 2
    return chunking.filter_ocr(blocks.where(ocr), blocks.where(~ocr)).select("chunk_index")


_BOTH = f"""{_DETAIL}, s AS (SELECT b.id, h.pct AS current, CASE WHEN b.id % 7 = 0 THEN NULL ELSE b.pct END AS base, h.sec AS fast, b.sec AS slow FROM d b JOIN d h ON h.id = b.id AND b.version = 'base' AND h.version = 'half')"""


@query(f"""WITH {_BOTH} SELECT id, round(current - base, 3) AS difference, CASE WHEN base = 0 THEN NULL ELSE round((current - base) / base * 100.0, 2) END AS change,
coalesce(printf('%.2f', CAST(current AS DOUBLE)), 'N/A') AS shown, coalesce(printf('%.2f', CAST(base AS DOUBLE)), 'N/A') AS shown_base,
CASE WHEN base IS NULL OR abs(current - base) < 1e-9 THEN '→' WHEN current > base THEN '▲' ELSE '▼' END AS arrow,
CASE WHEN abs(fast - slow) < 1e-9 THEN '→' WHEN fast < slow THEN '▲' ELSE '▼' END AS speed FROM s""")
def metric_changes(spark: SparkSession, folder: str) -> DataFrame:
    detail = _detail(spark, folder)
    side = lambda v, *names: detail.where(F.col("version") == v).select("id", F.col("answer_completeness_pct").alias(names[0]), F.col("response_time_sec").alias(names[1]))
    rows = side("base", "base", "slow").join(side("half", "current", "fast"), "id").withColumn("base", F.when(F.col("id") % 7 != 0, F.col("base")))
    now, before = F.col("current"), F.col("base")
    return rows.select("id", evaluation.difference(now, before).alias("difference"), evaluation.relative_change(now, before).alias("change"), evaluation.shown(now).alias("shown"), evaluation.shown(before).alias("shown_base"), evaluation.arrow(now - before).alias("arrow"), evaluation.arrow(F.col("fast") - F.col("slow"), lower_is_better=True).alias("speed"))


@query(f"""WITH {q.PAIRS} SELECT conv_id, turn, answer, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS n_evidence, CASE WHEN turn % 2 = 0 THEN CAST(turn AS DOUBLE) / 2 END AS seconds FROM pairs""")
def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    p = _pairs(spark, folder)
    whole = F.struct(F.col("answer").alias("final_answer"), F.array(F.struct(F.lit("a quote").alias("quote"))).alias("evidence"))
    other = F.struct(F.lit("").alias("final_answer"), F.col("answer"))
    raw = p.withColumn("raw", F.when(F.col("turn") % 3 == 0, F.to_json(whole)).when(F.col("turn") % 3 == 1, F.to_json(other)).otherwise(F.col("answer")))
    rows = raw.withColumn("seconds", F.when(F.col("turn") % 2 == 0, (F.col("turn") / 2).cast("string")).otherwise("n/a"))
    return rows.select("conv_id", "turn", evaluation.result_answer(F.col("raw")).alias("answer"), F.size(evaluation.result_evidence(F.col("raw"))).alias("n_evidence"), evaluation.safe_float(F.col("seconds")).alias("seconds"))
