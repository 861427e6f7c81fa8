"""Each stage of the pipeline against a plain version over the stage's own input."""

import math
import os
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gleanery.llm import decontam, toxicity
from gleanery.llm.common import fold

from .brute import near_groups, odd_rows, without_repeated_lines

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="needs the small tables")
def test_stages_equal_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    inputs, frames = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        frames[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {name: {r.doc_id: r for r in frames[name].collect()} for name, _ in corpus_pipeline.STAGES[:-1]}

    labelled = toxicity.sample_labelled(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"), fold(F.col("doc_id"), 4) != 2, "doc_id", "text", "toxic", 1000)
    machine = toxicity.train(labelled)
    rate = lambda text: machine.probability(toxicity.worst_two(machine.margins([u])[0] for u in (toxicity.plain(w) for w in toxicity.words_of(text)) if u))[0]
    calm = {k for k, r in inputs["toxicity"].items() if rate(r.text or "") < 0.3}
    assert set(kept["toxicity"]) == calm

    lines = without_repeated_lines([(k, r.text) for k, r in inputs["line_dedup"].items()], exact_words=1)
    left = {k: text for k, (text, removed) in lines.items() if not removed or text.strip()}
    assert {k: r.text for k, r in kept["line_dedup"].items()} == left
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].values())

    groups = near_groups([(k, r.text) for k, r in inputs["near_dedup"].items()], corpus_pipeline.NEAR_PERCENT)
    assert set(kept["near_dedup"]) == {k for k, c in groups.items() if k == c}

    items = [decontam.plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    search = decontam.ItemSearch(list(enumerate(items)), decontam.RATE)
    clean = {k for k, r in inputs["decontamination"].items() if not any(decontam.myers(i, decontam.plain(r.text), int(len(i) * decontam.RATE)) is not None for i in items)}
    assert set(kept["decontamination"]) == clean == {k for k, r in inputs["decontamination"].items() if not search.search(decontam.plain(r.text))}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for k, r in inputs["packing"].items()}
    lengths, sequences = defaultdict(int), defaultdict(int)
    for r in frames["packing"].collect():
        lengths[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert lengths == want and max(sequences.values()) <= 2048
    assert len(sequences) <= math.ceil(sum(want.values()) / 2048) + 1


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="needs the small tables")
def test_stages_bear_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing and missing columns, and an empty table; columns stay as they are."""
    odd = odd_rows(spark)
    for name in ("predicted", "row", "digest", "n_removed", "emptied", "kept", "component_id", "doc", "body", "gone"):
        odd = odd.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns and out.count() == odd.count(), name
        assert {r.doc_id for r in out.collect()} >= {None, 2, 3, 4, 7}
        assert stage(spark, odd.limit(0), FOLDER).count() == 0
    plain = odd.select("doc_id", "text", "lang")
    packed = corpus_pipeline.pack_sequences(spark, plain, FOLDER).collect()
    assert len({(r.doc_id, r.sequence_id, r.offset) for r in packed}) == len(packed) and {r.doc_id for r in packed} == {r.doc_id for r in plain.collect()}
    assert corpus_pipeline.pack_sequences(spark, plain.limit(0), FOLDER).count() == 0
