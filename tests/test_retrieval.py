"""Retrieval operators on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from gleanery.operators import chunking, context, evaluation, evidence, retrieval, sinks, units
from gleanery.sources import readers


def test_bm25_and_the_floor(spark):
    chunks = spark.createDataFrame([(0, "aa bb"), (1, "aa"), (2, "cc")], "chunk_index long, text string")
    asked = spark.createDataFrame([(7, "bb")], "qid long, query string")
    got = {r.chunk_index: r.score for r in retrieval.bm25_top_k(chunks, asked, 3).collect()}
    assert got[0] == pytest.approx(0.4170005, abs=1e-6) and got[1] == got[2] == 0
    weights = {r.term: r.idf for r in retrieval.term_weights(chunks).collect()}
    assert weights["aa"] == pytest.approx(0.25 * (math.log(2.5 / 1.5) * 2 + math.log(1.5 / 2.5)) / 3)


def test_rank_fusion(spark):
    rows = lambda ids: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "qid long, chunk_index long, rank int")
    got = {r.chunk_index: r.rrf_score for r in retrieval.fuse_ranks([rows([10, 20]), rows([20, 30])]).collect()}
    assert got[20] == pytest.approx(1 / 62 + 1 / 61) and got[10] == pytest.approx(1 / 61) and got[30] == pytest.approx(1 / 62)


def test_dense_top_k_is_exact(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "chunk_index long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "qid long, embedding array<float>")
    got = retrieval.dense_top_k(vectors, asked, 2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.chunk_index) for r in got] == [(1, 9), (1, 8), (2, 0), (2, 1)]


@pytest.mark.parametrize(("pool_k", "regular"), [(40, 32), (10, 8), (1, 1)])
def test_pool_sizes(spark, pool_k, regular):
    rows = spark.range(100).select(F.lit(1).alias("question_id"), F.col("id").alias("chunk_index"), (-F.col("id").cast("double")).alias("merge_score"), F.col("id").cast("double").alias("anchor_score"))
    got = retrieval.rerank_pool(rows, pool_k).collect()
    assert len(got) == pool_k and sum(r.pool_class == 0 for r in got) == regular


def test_neighbors_and_parents(spark):
    blocks = spark.createDataFrame([(i, 1, i) for i in range(10)], "chunk_index long, page long, block_no int")
    hits = spark.createDataFrame([(1, 4, 1, 0), (1, 5, 2, 0)], "qid long, chunk_index long, rank int, parent_index long")
    got = {r.chunk_index: (r.context_type, r.expanded_from) for r in context.expand_neighbors(hits, blocks, 1).collect()}
    assert got == {3: ("neighbor", 4), 4: ("retrieved", 4), 5: ("retrieved", 5), 6: ("neighbor", 5)}
    parents = [r for r in context.add_parents(hits, blocks).collect() if r.context_type == "parent_section"]
    assert [(r.chunk_index, r.rank, r.expanded_from) for r in parents] == [(0, 1, 4)]


def test_table_markdown(spark):
    table = F.array(F.array(F.lit("a"), F.lit(None).cast("string")), F.array(F.lit(" "), F.lit("")), F.array(F.lit("b")))
    assert spark.range(1).select(chunking.table_markdown(table)).first()[0] == "| a |  |\n| --- | --- |\n| b |  |"


def test_long_units_are_packed(spark):
    text = "가나다. " * 40
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    got = [r.unit for r in units.answer_units(rows, "id", "text", 50).orderBy("unit_no").collect()]
    assert all(len(u) <= 50 for u in got) and len(got) >= 1


def test_dedupe_is_idempotent(spark):
    rows = spark.createDataFrame([(1, i, "text", "body", t, 1.0) for i, t in enumerate(["same words here", "same words here!", "other thing"])], "qid long, unit_no long, kind string, role string, text string, score double")
    once = units.dedupe_units(rows)
    assert sorted(r.unit_no for r in once.collect()) == [0, 2]
    assert sorted(r.unit_no for r in units.dedupe_units(once).collect()) == [0, 2]


def test_budget_keeps_the_least(spark):
    rows = spark.createDataFrame([(1, i, "x" * 400) for i in range(1, 8)], "qid long, rank int, text string")
    assert [r["rank"] for r in units.within_budget(rows, 10).orderBy("rank").collect()] == [1, 2, 3]
    cut = evidence.fit_budget(rows.withColumnRenamed("rank", "evidence_no"), 200).collect()
    assert len(cut) == 2 or sum(r.tokens_to_here <= 200 for r in cut) >= 1


def test_requirements_share_the_quota(spark):
    scores = spark.createDataFrame([(1, r, e, 5, 1.0 - e / 10) for r in (1, 2) for e in (1, 2, 3)], "qid long, requirement_no long, evidence_no long, source_chunk_id long, score double")
    got = sorted((r.requirement_no, r.evidence_no) for r in evidence.map_requirements(scores).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_completeness_and_strict_hits(spark):
    need = F.array(F.struct(F.lit("a").alias("label"), F.array(F.lit("신청한 즉시")).alias("aliases")), F.struct(F.lit("b").alias("label"), F.array(F.lit("24시간")).alias("aliases")))
    assert spark.range(1).select(evaluation.completeness(F.lit("신청한 즉시 발급됩니다"), need)).first()[0] == 50.0
    found = F.array(F.struct(F.lit("24시간").alias("quote"), F.lit("").alias("title"), F.lit("p.9").alias("page"), F.lit("섹션 3").alias("locator")))
    pages = F.array(F.struct(F.array(F.lit(3)).alias("pages"), F.array(F.lit("24시간")).alias("aliases")))
    got = spark.range(1).select(evaluation.hit_rate(found, pages), evaluation.hit_rate(found, pages, strict=True)).first()
    assert tuple(got) == (100.0, 0.0)


def test_chunks_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(3, "first block of it\nsecond block here\nshort", "s")], "doc_id long, text string, source string")
    blocks = readers.text_blocks(docs)
    sinks.write_chunks(blocks, str(tmp_path / "chunks"))
    back = readers.read_chunks(spark, str(tmp_path / "chunks"))
    assert sorted(r.text for r in back.collect()) == ["first block of it", "second block here"]
    assert back.where("parent_id IS NULL").count() == 2
    assert sorted(r[0] for r in back.select(readers.block_number(F.col("chunk_id"))).collect()) == [0, 1]


def test_vectors_that_cannot_be_compared_are_not_found(spark):
    from gleanery.operators.retrieval import dense_top_k

    rows = [(1, [1.0, 0.0]), (2, [0.5, None]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [])]
    table = spark.createDataFrame(rows, "chunk_index long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0, 2.0]), (7, [None, 1.0])], "qid long, embedding array<double>")
    assert sorted((r.qid, r.chunk_index, r.score) for r in dense_top_k(table, asked, 3).collect()) == [(8, 3, 0.0), (9, 1, 1.0)]


def test_hits_that_are_no_blocks_keep_their_place(spark):
    from gleanery.operators.context import expand_neighbors

    hits = spark.createDataFrame([(1, 10, 1), (1, 99, 2)], "qid long, chunk_index long, rank int")
    blocks = spark.createDataFrame([(9, 1, 0), (10, 1, 1), (11, 1, 2)], "chunk_index long, page long, block_no int")
    got = [(r.chunk_index, r.context_type) for r in expand_neighbors(hits, blocks, 1).orderBy("position").collect()]
    assert got == [(9, "neighbor"), (10, "retrieved"), (11, "neighbor"), (99, "retrieved")]
