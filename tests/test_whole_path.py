"""The path from question to answer reaches every part of a long text."""

import random
import time

import pytest

from gleanery.config import RetrievalConfig
from gleanery.operators import retrieval
from gleanery.plans import catalog
from gleanery.plans.engine import answer_questions


def test_end_of_a_long_text_answers(spark):
    filler = " ".join(f"filler{i} words, and more" for i in range(400))
    wanted = "zebra quagga okapi live in the northern enclosure."
    chunks = spark.createDataFrame([(1, filler + ". " + wanted), (2, "something else entirely")], "chunk_index long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_index long, embedding array<double>")
    asked = spark.createDataFrame([(7, "zebra quagga okapi enclosure", [1.0, 0.0])], "qid long, query string, embedding array<double>")
    answer = answer_questions(chunks, vectors, asked, RetrievalConfig()).first()
    assert "quagga okapi live in the northern enclosure" in answer.final_answer and answer.n_units > 1


def test_words_after_the_twelfth_find_documents(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve zebra quagga okapi"
    others = [(i, f"unrelated passage number{i} about weather") for i in range(1, 31)]
    spark.createDataFrame([*others, (99, "zebra quagga okapi live in the north")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, [1.0, 0.0]) for i in range(1, 31)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    answer = catalog.QUERIES["end_to_end"](spark, str(tmp_path)).first()
    assert answer.final_answer.startswith("zebra quagga okapi live in the north")


def test_the_corpus_is_not_shuffled(spark):
    draw = random.Random(0)
    texts = [(i, " ".join(f"word{draw.randrange(2000)}" for _ in range(4000))) for i in range(200)]
    chunks = spark.createDataFrame(texts, "chunk_index long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_index long, embedding array<double>")
    asked = spark.createDataFrame([(7, texts[3][1][:400], None)], "qid long, query string, embedding array<double>")

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(1)
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = shuffled()
    answer = answer_questions(chunks, vectors, asked, RetrievalConfig(top_k=1)).first()
    assert answer.n_units > 0 and shuffled() - before < sum(len(t) for _, t in texts) / 4


def test_best_scores_in_parts(spark, monkeypatch):
    texts = [(i, " ".join(f"w{j}" for j in range(60) if (i * j) % 7 < 3) + f" own{i}" + f" w{i % 5}" * (i % 11)) for i in range(300)]
    chunks = spark.createDataFrame([*texts, (300, None), (301, "")], "chunk_index long, text string").repartition(3)
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q} w{2 * q}") for q in range(1, 9)] + [(9, "unknown")], "qid long, query string")
    whole = [tuple(r) for r in retrieval.bm25_top_k(chunks, asked, 5).orderBy("qid", "rank").collect()]
    weights = {r.term: r.idf for r in retrieval.term_weights(chunks).collect()}
    dl = {i: len(t.split()) for i, t in texts}
    avgdl = sum(dl.values()) / 301
    for q in range(1, 9):
        score = dict.fromkeys(range(302), 0.0)
        for i, t in texts:
            for w in f"w{q} w{q + 1} w{q} w{2 * q}".split():
                tf = t.split().count(w)
                score[i] += weights[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl[i] / avgdl)) if tf else 0
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        assert [r[1] for r in whole if r[0] == q] == best and [r[2] for r in whole if r[0] == q] == pytest.approx([score[i] for i in best])
    assert [r[1] for r in whole if r[0] == 9] == [0, 1, 2, 3, 4]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    parts = [tuple(r) for r in retrieval.bm25_top_k(chunks, asked, 5).orderBy("qid", "rank").collect()]
    assert [r[:2] for r in parts] == [r[:2] for r in whole] and [r[2] for r in parts] == pytest.approx([r[2] for r in whole])
