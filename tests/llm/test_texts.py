"""Operators on texts: languages, token counts, packing, toxicity, shards and chats."""

import hashlib
import math
import os
import pickle
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanery.llm import chat, langid, packing, sharding, tokens, toxicity

from .brute import odd_rows

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
CODEC = tokens.PreTokenCodec(VOCABULARY, list)


def ids_of(text):
    words = CODEC.cut(text)
    known = CODEC.learn(set(words))
    return [i for w in words for i in known[w]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_tokens_equal_the_library(text):
    assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=[chr(c) for c in range(0x180)] + list("'<|>tsrevmld"), max_size=60))
def test_tokens_equal_the_library_on_latin(text):
    assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_latin_character_and_special_strings():
    for c in range(0x180):
        text = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2"
        assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids, c
    text = "x<|endoftext|>y <|startoftext|> Don't we'LL İstanbul Å é"
    assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_pre_tokens_of_the_fast_cut_need_the_model_alone():
    codec = tokens.PreTokenCodec(VOCABULARY, list)
    words = {"straße", "don", "'t", "…", "\x01", "\x7f", "ſ", "7", "?!", *tokens._PRE.findall("l'été à noël, ¡qué año! §5 ~{}")} - {"…"}
    want = {w: codec._library.encode(w, add_special_tokens=False).ids for w in words}
    codec._library = None
    known = codec.learn(words)
    assert {w: known[w] for w in words} == want


def test_token_counts_of_odd_rows(spark):
    docs = odd_rows(spark)
    got = tokens.token_counts(docs, VOCABULARY).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in got])) == sorted(map(str, want))
    assert any(r.over_limit for r in got) and all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert tokens.token_counts(docs.limit(0), VOCABULARY).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=14), st.integers(0, 40))
def test_fullest_is_the_best_sum(lengths, room):
    counts = sorted(Counter(lengths).items(), reverse=True)
    got = packing.fullest(counts, room)
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    assert sum(got) == max(sums) and not Counter(got) - Counter(lengths)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins_use_every_length_once(lengths):
    bins = packing.minimum_bin_slack(lengths, 64)
    used = Counter()
    for one, times in bins:
        assert sum(one) <= 64
        for x in one:
            used[x] += times
    assert used == Counter(lengths)
    assert sum(t for _, t in bins) <= max(1, 2 * math.ceil(sum(lengths) / 64))


def test_packing_odd_rows(spark):
    docs = odd_rows(spark)
    rows = packing.pack(tokens.token_pieces(docs, VOCABULARY), group_rows=5).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for doc in docs.where("doc_id IS NOT NULL AND doc_id <> 1").collect():
        want = LIBRARY.encode(doc.text or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[doc.doc_id])
        assert [p for p, *_ in parts] == list(range(math.ceil(len(want) / 2048)))
        assert [s for _, s, *_ in parts] == [2048 * i for i in range(len(parts))]
        assert np.frombuffer(b"".join(b for *_, b in parts), dtype="<u4").tolist() == want
    assert len(by_doc[1]) == 2
    assert packing.pack(tokens.token_pieces(docs.limit(0), VOCABULARY)).count() == 0


def code_length(text, grams, alphabet_bits=8.0):
    """Plain recursion of the model: counts of contexts of orders 0 to 3 by dictionary."""
    tables = [defaultdict(Counter) for _ in range(4)]
    for gram, n in grams.items():
        for k in range(4):
            tables[k][gram[3 - k : 3]][gram[3]] += n

    def probability(symbol, context, k):
        below = lambda s: 1 / 256 if k == 0 else probability(s, context[1:], k - 1)
        seen = tables[k].get(context)
        if not seen or (k == 3 and sum(seen.values()) < 2):
            return below(symbol)
        total, distinct = sum(seen.values()), len(seen)
        if symbol in seen:
            return seen[symbol] / (total + distinct)
        return distinct / (total + distinct) * below(symbol) / max(1 - sum(map(below, seen)), 1e-12)

    data = b"\n\n\n" + text
    return -sum(math.log2(probability(data[i], data[i - 3 : i], 3)) for i in range(3, len(data)))


def test_code_lengths_equal_the_recursion():
    sample = b"\n\n\nthe cat sat on the mat and the rat ate the cat"
    grams = Counter(sample[i : i + 4] for i in range(len(sample) - 3))
    rows = [("en", int.from_bytes(g, "big"), n) for g, n in grams.items()]
    model = langid.CodeLengths(rows)
    for text in (b"the cat", b"xyz the", b"", b"mat\xffrat"):
        assert model.lengths([text, b"the"])[0, 0] == pytest.approx(code_length(text, grams), rel=1e-4)


def test_languages(spark):
    rng = random.Random(5)
    words = {"en": "the of and ing tion with from".split(), "de": "der die und keit ung mit von".split()}
    rows = [(100 + i, " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "de"] * 40)]
    docs = odd_rows(spark, rows).unionByName(odd_rows(spark))
    got = {r.doc_id: r for r in langid.identify_languages(docs, F.col("doc_id") % 5 != 0).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in rows if k % 5 == 0) >= 15
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (2, 3, 4, 7))
    marks = odd_rows(spark, [(9000, "\u00bd \u00b2 \u2462", "en"), (9001, "\u00aa", "en")])
    assert {r.doc_id: r.lang_pred == "und" for r in langid.identify_languages(docs.unionByName(marks), F.col("doc_id") < 9000).collect() if r.doc_id in (9000, 9001)} == {9000: True, 9001: False}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[6].lang_pred in ("en", "de")
    nothing = langid.identify_languages(docs, F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == docs.count()
    assert langid.identify_languages(docs.limit(0), F.lit(True)).count() == 0


def kernel(a, b):
    """Gap-weighted common subsequences of four symbols with at most two skipped, by enumeration."""

    def features(unit):
        s, out = "^" + unit + "^", Counter()
        for i in range(len(s)):
            for x, y, z in toxicity._STEPS:
                if i + x + y + z < len(s):
                    out[s[i] + s[i + x] + s[i + x + y] + s[i + x + y + z]] += toxicity.DECAY ** (x + y + z + 1)
        return out

    fa, fb = features(a), features(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    return dot(fa, fb) / math.sqrt(dot(fa, fa) * dot(fb, fb))


def test_features_give_the_kernel():
    units = ["idiot", "idxiot", "banana", "anan", "in"]
    code, weight = toxicity.features(units)
    dense = np.zeros((len(units), toxicity.SYMBOLS**4))
    for i in range(len(units)):
        np.add.at(dense[i], code[i], weight[i])
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            assert dense[i] @ dense[j] == pytest.approx(kernel(a, b), abs=1e-5)


def test_units():
    assert "idiot" in toxicity.units_of("You i d i o t there") and "idiot" in toxicity.units_of("an i-d-i-o-t!")
    assert toxicity.units_of("") == set() and toxicity.worst_two([]) == (toxicity.FLOOR, toxicity.FLOOR)


def test_toxicity_held_out_and_odd_rows(spark):
    rng = random.Random(2)
    clean = ["harbour", "window", "summer", "garden", "silver", "paper", "stone", "river", "morning", "table"]
    bad = ["blorgface", "snivelrat", "gruntoid"]
    rows = [(100 + i, " ".join(rng.choices(clean, k=30) + ([rng.choice(bad)] if i % 3 == 0 else [])), "en") for i in range(150)]
    docs = odd_rows(spark, rows).unionByName(odd_rows(spark))
    labels = spark.createDataFrame([(k, int((k - 100) % 3 == 0)) for k, _, _ in rows] + [(3, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, labels, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in scored.collect()}
    assert all(got[k].predicted == ((k - 100) % 3 == 0) for k, _, _ in rows if k % 4 == 2)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2].predicted == 0 and got[3].predicted == 0
    gap = odd_rows(spark, [(1, "a b-l-o-r-g-f-a-c-e in the garden", "en"), (2, "silver river stone", "en")])
    more = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs.unionByName(gap.withColumn("doc_id", F.col("doc_id") + 5000)), labels, F.col("doc_id") % 4 != 2).collect()}
    assert more[5001] == 1 and more[5002] == 0
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0}
    assert toxicity.score_toxicity(docs.limit(0), labels, F.lit(True)).count() == 0
    assert toxicity.score_toxicity(docs, labels, F.lit(True)).columns == ["doc_id", "score", "predicted"]


def test_training_is_not_done_on_the_driver(spark, monkeypatch):
    """The driver gets the machine that train makes of the sample, without training or gathering texts itself."""
    driver, plain_train = os.getpid(), toxicity.train
    texts = [f"river harbor market window number {i}" + (" blorgface" if i % 3 == 0 else "") for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    sampled = lambda rows: toxicity.labelled_bags(docs, rows, F.lit(True), "doc_id", "text", "toxic", 1000)
    want = plain_train([(toxicity.bag_of(t), int(i % 3 == 0)) for i, t in enumerate(texts)])

    def train(*args, **options):
        assert os.getpid() != driver
        return plain_train(*args, **options)

    with monkeypatch.context() as patch:
        patch.setattr(toxicity, "train", train)
        machine = toxicity.trained(sampled(labels), 4000, 2000)
        scored = toxicity.score_toxicity(docs, labels, F.lit(True))
    assert np.allclose(machine.weights, want.weights, atol=1e-5) and np.allclose([machine.bias, *machine.curve], [want.bias, *want.curve], atol=1e-5)
    assert {r.doc_id for r in scored.where("predicted = 1").collect()} == {i for i in range(90) if i % 3 == 0}
    assert not toxicity.trained(sampled(labels.limit(0)), 4000, 2000).weights.any()
    sent = pickle.dumps(machine)
    assert len(sent) < 1 << 20 and np.array_equal(pickle.loads(sent).weights, machine.weights)


def test_labels_are_learned_from_the_given_rows_only(spark):
    """Held-out labels change nothing, not even which rows are sampled; a key with both labels is toxic."""
    rows = [(i, f"text number {chr(97 + i % 26) * 3} of many", "en") for i in range(400)]
    docs = odd_rows(spark, rows)
    learn = F.col("doc_id") % 4 != 2
    some = [(i, int(i % 5 == 0)) for i in range(400)]
    sampled = lambda labels: sorted(toxicity.sample_labelled(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), learn, "doc_id", "text", "toxic", 40))
    one = sampled(some)
    assert one == sampled([(i, 1 if i % 4 == 2 else y) for i, y in some]) and 20 < len(one) < 160
    both = sampled(some + [(i, 0) for i, y in some if y])
    assert both == one and {y for _, y in one} == {0, 1}


def test_machine_equals_an_explicit_kernel_machine():
    """The folded weights give the margins of a kernel expansion: Nystroem features of a text's units by explicit kernels."""
    clean = ["harbour", "window", "summer", "garden", "silver", "paper", "stone", "river", "morning", "table"]
    rng = random.Random(4)
    texts = [(" ".join(rng.choices(clean, k=12) + (["blorgface"] if i % 2 else [])), i % 2) for i in range(30)]
    machine = toxicity.train([(toxicity.bag_of(t), y) for t, y in texts])
    # A margin is linear in the kernel: it is bias + sum of coefficients times kernels with the units that carry weight.
    units = [*clean, "blorgface"]
    k = np.asarray([[kernel(a, b) for b in units] for a in units])
    coefficients = np.linalg.lstsq(k, machine.margins(units) - machine.bias, rcond=None)[0]
    # The weights lie in the span of the landmarks, and here these are among the units and their bent forms.
    assert np.allclose(k @ coefficients + machine.bias, machine.margins(units), atol=1e-4)
    code, weight = toxicity.features(["blxorgface", "harbor"])
    explicit = [sum(float(machine.weights[c]) * w for c, w in zip(code[i], weight[i], strict=True)) + machine.bias for i in range(2)]
    assert np.allclose(machine.margins(["blxorgface", "harbor"]), explicit, atol=1e-4)
    assert machine.margins(["blxorgface"])[0] > machine.margins(clean).max()
    assert machine.probability([toxicity.worst_two(machine.margins([u])[0] for u in ("blorgface", "river"))])[0] >= 0.3 > machine.probability([toxicity.worst_two(machine.margins(clean))])[0]


def test_lpt_is_greedy():
    sizes = [(9, "a"), (7, "b"), (6, "c"), (5, "d"), (5, "e"), (4, "f")]
    placed = sharding.lpt(sizes, 3)
    loads = Counter()
    for size, job in sizes:
        loads[placed[job]] += size
    assert sorted(loads.values()) == [11, 12, 13] and sharding.lpt([], 3) == {}


def test_shards(spark):
    rng = random.Random(1)
    rows = [(10_000 + i, "w" * rng.randint(0, 400), "en") for i in range(2000)] + [(5000 + i, "copy of one text", "en") for i in range(300)]
    docs = odd_rows(spark, rows).unionByName(odd_rows(spark))
    got = sharding.lpt_shards(docs, 7).collect()
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert len(got) == docs.count()
    where = {}
    by_key = {k: t for k, t in texts}
    slots, loads = defaultdict(list), Counter()
    for r in got:
        text = by_key[r.doc_id]
        assert (r["size"], r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
        assert where.setdefault(text, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = [v for s, v in loads.items() if v < 200_000]  # one shard has the long text
    assert max(rest) <= 1.05 * min(rest)
    assert sharding.lpt_shards(docs.limit(0), 7).count() == 0


def test_chats(spark):
    rows = [
        (1, 0, "system", "be <turn/> kind"), (1, 1, "user", "hi\\m there"), (1, 2, "assistant", "<turn user< :>\nno\\\\e"), (1, 3, "user", None), (1, 4, "assistant", "b"),
        (2, 0, "assistant", "x"), (3, 0, "user", "only"), (4, 0, "user", "q"), (4, 0, "user", "q"), (5, None, None, None), (None, 1, "user", "no conversation"),
    ]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, conv string, one string")
    made = chat.format_chats(turns)
    got = {r.conv_id: r for r in chat.parse_chats(made).collect()}
    for conv in (1, 2, 3, 4, 5, None):
        want = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(p["role"], p["text"]) for p in got[conv].parsed] == [(x[1], x[2]) for x in want]
        assert "".join(s["text"] for s in got[conv].segments) == got[conv].formatted
    assert {k: (r.valid, r.first_error) for k, r in got.items()} == {1: (True, None), 2: (False, 0), 3: (False, 1), 4: (False, 1), 5: (False, 0), None: (False, 1)}
    digest = {r.conv_id: r for r in chat.chat_digests(chat.parse_chats(made)).collect()}[1]
    loss = "<turn user< :>\nno\\\\e" + "b"
    assert (digest.loss_chars, digest.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # The loss comes from the emitted mask: with every flag set, all segments are under it.
    wrong = made.withColumn("segments", F.transform("segments", lambda x: x.withField("loss", F.lit(True))))
    other = {r.conv_id: r for r in chat.chat_digests(chat.parse_chats(wrong)).collect()}[1]
    assert other.loss_sha256 != digest.loss_sha256 and other.turns_sha256 == digest.turns_sha256 and other.loss_chars > digest.loss_chars
    assert chat.format_chats(turns.limit(0)).count() == 0
