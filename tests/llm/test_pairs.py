"""Operators on pairs: near copies, vectors, lines and benchmark items."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.llm import common, decontam, itq, linededup, minhash
from gleanery.llm import graph
from gleanery.llm.graph import add_links, connected_components

from .brute import components, edit_distance_in, near_groups, odd_rows, shingles, within_one_edit, without_repeated_lines


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (1, 0), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    clean = [(a, b) for a, b in links if a is not None and a != b]
    want = components({x for pair in clean for x in pair}, clean)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("at_once", [0, 20_000])
def test_later_links_join_components(spark, monkeypatch, at_once):
    """Both in rounds and in one task; the later links join two components, add vertices, and make a new component."""
    monkeypatch.setattr(graph, "ONE_TASK", at_once)
    first, later = [(5, 9), (9, 7), (3, 4), (20, 21)], [(7, 4), (21, 30), (40, 41), (5, 9)]
    parts = connected_components(spark.createDataFrame(first, "a long, b long"))
    got = {r.id: r.component for r in add_links(parts, spark.createDataFrame(later, "a long, b long")).collect()}
    assert got == components({x for pair in first + later for x in pair}, first + later)
    none = spark.createDataFrame([], "a long, b long")
    assert {r.id: r.component for r in add_links(parts, none).collect()} == components({x for p in first for x in p}, first)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbB \t\n\x0bé\x1c", max_size=40), max_size=5))
def test_set_sizes(values):
    assert [len(s) for s in minhash.shingle_sets(values)] == [len(shingles(v)) for v in values]


def near_rows(seed=4):
    """Groups of copies with words replaced, short texts, and a shared passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, key = [], 0
    for _ in range(8):
        base = [word() for _ in range(rng.choice([4, 7, 14, 60, 200]))]
        for _ in range(7):
            other = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                other[rng.randrange(len(other))] = word()
            rows.append((key, " ".join(other).title() if rng.random() < 0.3 else "  ".join(other), "en"))
            key += 1
    passage = " ".join(word() for _ in range(40))
    rows += [(key + i, passage + " " + " ".join(word() for _ in range(60)), "en") for i in range(20)]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = {r.doc_id: r for r in minhash.near_duplicates(odd_rows(spark, rows)).collect()}
    want = near_groups([r[:2] for r in rows])
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(shingles(t)) for k, t, _ in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def copies_of_one(n, seed=11):
    """Near copies of one text of 120 words: most are linked with few others, some in chains and groups of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(120)]
    second = [word() if 40 <= i < 55 else w for i, w in enumerate(base)]
    some = [word() for _ in range(6)]
    rows = []
    for key in range(n):
        other = list(base if rng.random() < 0.6 else second)
        for _ in range(rng.choice([1, 2, 3, 4, 4, 5, 6])):
            other[rng.randrange(120) if rng.random() < 0.6 else rng.choice([7, 60, 90])] = rng.choice(some) if rng.random() < 0.7 else word()
        rows.append((key, " ".join(other), "en"))
    return rows


def near_groups_at_once(rows, percent):
    """near_groups by a product of matrices."""
    sets = [shingles(t) for _, t, _ in rows]
    place = {e: i for i, e in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(place)), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, [place[e] for e in s]] = 1
    common = m @ m.T
    size = np.asarray([len(s) for s in sets])
    a, b = np.nonzero(np.triu(100 * common >= percent * (size[:, None] + size[None] - common), 1))
    return components([k for k, _, _ in rows], [(rows[i][0], rows[j][0]) for i, j in zip(a, b, strict=True)])


@pytest.mark.parametrize("percent, long, n", [(80, 100, 2000), (85, 3, 600)])
def test_near_copies_of_one_text_equal_brute_force(spark, monkeypatch, percent, long, n):
    """Both with lists of differences that get centres of their own, and without."""
    monkeypatch.setattr(minhash, "LONG_LIST", long)
    monkeypatch.setattr(minhash, "TURNS", 2)
    rows = copies_of_one(n)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string"), percent=percent).collect()}
    want = near_groups_at_once(rows, percent)
    assert got == want and n // 20 < len(set(want.values())) < n - n // 20


def test_near_duplicates_without_or_with_repeated_keys(spark):
    """A row without a key is linked with nothing; a key with two texts has a class for each."""
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(None, a), (7, a), (8, a), (8, b), (9, b), (4, "other words than all the rest have")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, None, True), (7, 7, True), (8, 7, False), (8, 8, True), (9, 8, False), (4, 4, True)], key=str)


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_rows(spark)
    got = [(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()]
    assert len(got) == docs.count()
    assert all(k == c for k, c in got)
    assert all(r.kept for r in minhash.near_duplicates(docs).collect())
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 64))
    x = [(centres[i % 40] + 0.02 * (i % 9) * rng.standard_normal(64)).tolist() for i in range(400)]
    rows = [(i, v) for i, v in enumerate(x)] + [(900, x[0]), (901, x[0]), (902, None), (903, []), (904, [0.0] * 64), (905, [None] * 64), (906, [float("nan")] * 64), (907, [1.0, 2.0]), (908, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, id string, key string")
    got = {r.vec_id: r for r in itq.near_vectors(table).collect()}
    m = np.asarray(x + [x[0], x[0]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    keys = [*range(400), 900, 901]
    near = m @ m.T >= 0.95
    links = [(keys[i], keys[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    found = sum(got[k].n_links for k in keys) / 2
    assert 0.9 * len(links) <= found <= len(links)
    want = components(keys, links)
    assert sum(got[k].component_id == want[k] for k in keys) >= 0.95 * len(keys)
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(902, 907))
    assert got[908].component_id == 907 and got[908].n_links == 1 and not got[908].kept
    assert itq.near_vectors(table.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é", min_size=1, max_size=40), st.data())
def test_one_edit_shares_a_block_and_a_variant(a, data):
    i = data.draw(st.integers(0, len(a) - 1))
    kind = data.draw(st.sampled_from(["swap", "delete", "insert"]))
    b = a[:i] + {"swap": "x", "delete": "", "insert": "x" + a[i]}[kind] + a[i + 1 :]
    if not b or not within_one_edit(a, b):
        return
    for blocks in (2, linededup.BLOCKS):
        ka, kb = linededup.block_keys(a, blocks), linededup.block_keys(b, blocks)
        shared = set(ka) & set(kb)
        assert shared
    places = lambda keys: [p for p, k in enumerate(keys) if k in shared]
    (va, ta), (vb, tb) = linededup.variant_keys(a, places(ka), blocks), linededup.variant_keys(b, places(kb), blocks)
    meet = {(v, t) for v, t in zip(va, ta, strict=True)} & {(v, t) for v, t in zip(vb, tb, strict=True) if t == 2}
    own = (set(va[ta == 0]) & set(vb[tb == 1])) | (set(va[ta == 1]) & set(vb[tb == 0]))
    assert meet or own or a == b


def line_rows(seed=6):
    rng = random.Random(seed)
    lines = [" ".join("".join(rng.choices("abcd", k=4)) for _ in range(9)) for _ in range(25)] + ["short line", "", "  "]
    rows = []
    for key in range(60):
        some = rng.choices(lines, k=3)
        for i, line in enumerate(some):
            p = rng.randrange(len(line) or 1)
            some[i] = rng.choice([line, line, line.upper(), line[:p] + "x" + line[p + 1 :], line[:p] + line[p + 1 :], line + "é" * 3])
        rows.append((key, "\n".join(some), "en"))
    return rows


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(odd_rows(spark, rows)).collect()}
    assert got == without_repeated_lines([r[:2] for r in rows])


def test_lines_of_odd_rows(spark):
    docs = odd_rows(spark)
    out = linededup.dedup_lines(docs)
    got = out.collect()
    assert len(got) == docs.count() and set(docs.columns) < set(out.columns)
    assert {r.doc_id: r.n_removed for r in got if r.doc_id not in (1,)} == {k: 0 for k in (2, 3, 4, 5, 6, 7, 8, None)}
    assert {r.text for r in got if r.doc_id == 2} == {None} and not any(r.emptied for r in got if r.doc_id != 1)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    line = "one line of ten words that stands in all three rows"
    some = spark.createDataFrame([(None, line), (1, line), (2, line + "\nx")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(some).collect()} == {None: line, 1: line, 2: "x"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=12), st.text(alphabet="abc ", max_size=30))
def test_myers_equals_the_table(pattern, text):
    want = edit_distance_in(pattern, text)
    assert decontam.myers(pattern, text, len(pattern)) == want


def test_matches(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(12)]
    rows = []
    for key in range(60):
        text = list(items[key % 12][1])
        for _ in range(rng.choice([0, 2, 5, 9])):
            text[rng.randrange(len(text))] = rng.choice(["x", "", "xy"])
        inner = "".join(text).upper().replace(" ", rng.choice([" ", "\n", "  "]))
        rows.append((key, " ".join(word() for _ in range(15)) + " " + inner + " " + word(), "en"))
    docs = odd_rows(spark, rows).unionByName(odd_rows(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    table = spark.createDataFrame([*items, (90, None), (91, "  "), (92, "tiny item")], "item_id long, text string").withColumn("key", F.lit("x"))
    want = set()
    for key, text, _ in rows:
        for i, item in items:
            d = edit_distance_in(item, decontam.plain(text))
            if d <= int(len(item) * decontam.RATE):
                want.add((key, i, d))
    got = decontam.benchmark_matches(docs, table)
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == want and 10 < len(want) < 60
    parts = decontam.benchmark_matches(docs, table, block_bytes=600)
    assert {(r.doc_id, r.item_id, r.distance) for r in parts.collect()} == want
    kept = decontam.without_matches(docs, table)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({k for k, _, _ in want})
    assert decontam.benchmark_matches(docs, table.limit(0)).count() == 0
    assert decontam.benchmark_matches(docs.limit(0), table).count() == 0


def test_a_sweep_trims_the_drivers_jvm(spark, monkeypatch):
    said = []
    trim = common.trim_driver
    monkeypatch.setattr(common, "trim_driver", lambda s: said.append(trim(s)))
    monkeypatch.setattr(common, "SWEEP_S", 0.0)
    common.cut(spark.range(10))
    assert len(said) == 1 and said[0].startswith("Trim native heap")


def test_shuffle_files_go_with_the_tables_behind_a_cut(spark, monkeypatch):
    monkeypatch.setattr(common, "SWEEP_S", 0.0)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_(\d+)_", manager.getAllFiles().mkString(" ")))
    common.sweep(spark)
    time.sleep(2)
    before, rows = shuffles(), spark.range(100)
    for i in range(16):
        rows = common.cut(rows.withColumn("id", F.col("id") + i).repartition(3, "id"))
    common.sweep(spark)
    time.sleep(2)
    assert rows.count() == 100 and len(shuffles() - before) <= 6
