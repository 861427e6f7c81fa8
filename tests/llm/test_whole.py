"""Operators do the whole job: no reach that shrinks with the table, no floor and no prefix."""

import numpy as np

import corpus_pipeline
from gleanery.llm import itq, queries


def test_vectors_of_large_tables_meet(spark):
    """Recall at the least cosine itself, with the tables that four million vectors get."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((1500, 64)))
    aside = rng.standard_normal(x.shape)
    aside = unit(aside - (aside * x).sum(1, keepdims=True) * x)
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * aside
    rows = [(2 * i, v.tolist()) for i, v in enumerate(x)] + [(2 * i + 1, v.tolist()) for i, v in enumerate(y)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in itq.near_vectors(table, planned=1 << 22).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(1500)) >= 0.98 * 1500


def test_stage_drops_near_copies_from_four_fifths(spark):
    """One of 54 words replaced: 45 of 55 shingles in common, 0.818."""
    words = [f"w{i}" for i in range(54)]
    other = [*words[:27], "x", *words[28:]]
    far = [*words[:20], "x", *words[21:34], "y", *words[35:]]
    texts = {1: words, 2: other, 3: [f"v{i}" for i in range(54)], 4: far}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 3, 4}


def test_short_lines_go_if_equal(spark, tmp_path):
    """Equal lines of any length go, in the query and in the stage; short lines one edit apart stay."""
    texts = [(1, "All rights reserved.\n\nfirst"), (2, "second\n\n all  RIGHTS reserved.\nlast"), (3, "All rights reserved"), (4, "\n \n"), (5, "second\nfirst")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.emptied) for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, False), 2: (1, False), 3: (0, False), 4: (0, False), 5: (2, True)}
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert left == {1: texts[0][1], 2: "second\n\nlast", 3: texts[2][1], 4: texts[3][1]}
