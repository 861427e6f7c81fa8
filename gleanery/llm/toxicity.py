"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

A text is cut into units: its words without marks, runs of single letters joined, loose accents
dropped; a long unit becomes overlapping windows. The kernel of two units is the gap-weighted
number of common subsequences of four symbols, each weighted by DECAY to the power of its span,
with at most two symbols skipped, normalised to 1 for equal units. So an insult with a mark or a
letter put in keeps most of its kernel with the plain one. Every unit is described by its kernels
to landmark units (Nystroem features), and a linear machine is trained on them from labelled
texts: a toxic text answers for its worst unit (chosen anew in each pass), a clean one for all.

As the kernel's features are explicit, the machine's weights fold back to one weight for each
subsequence, so a new unit is scored exactly without visiting the landmarks.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import release, resident, slices, sweep, texts

DECAY = 0.6
LENGTH, GAPS, WIDTH, STEP = 4, 2, 24, 12
#: 26 letters, the edge of a unit, and twelve classes of all other characters; 0 fills up.
SYMBOLS = 40
#: Steps between the four symbols, and the span, of every subsequence with at most GAPS skips.
_STEPS = [(a, b, c) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3) if a + b + c <= LENGTH - 1 + GAPS]
_POWERS = np.asarray([DECAY**k if k else 0.0 for k in range(16)], dtype=np.float32)

_MARKS = re.compile(r"[^\w\s]|[\d_]")
_SPELT = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_PLAIN = re.compile("[^a-z]")


def words_of(text: str) -> set[str]:
    """The distinct words of a whole text, as they stand, and its runs of spelt letters, joined."""
    text = text.lower()
    words = set(text.split())
    if _SPELT.search(text):
        words.update("".join(m.split()) for m in _SPELT.findall(text))
    return words


def plain(word: str) -> str:
    """The word without marks; empty if too short for a subsequence of four (two edges count)."""
    unit = word if word.isalpha() else _MARKS.sub("", word)
    return unit if len(unit) > 1 else ""


def units_of(text: str) -> set[str]:
    """The distinct units of a whole text."""
    return {plain(w) for w in words_of(text)} - {""}


def _folded(unit: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFC", unit) if not unicodedata.combining(c)) if _PLAIN.search(unit) else unit


def _windows(unit: str) -> list[str]:
    unit = _folded(unit)
    return [unit[i : i + WIDTH] for i in range(0, max(1, len(unit) - WIDTH + STEP), STEP)]


def _symbols(units: list[str]) -> np.ndarray:
    """One row of symbols for each unit, with an edge symbol on both sides; 0 fills up."""
    codes = np.array(units).view(np.uint32).reshape(len(units), -1).astype(np.int32)
    out = np.zeros((len(units), codes.shape[1] + 2), dtype=np.int32)
    out[:, 1:-1] = np.where((codes >= 97) & (codes <= 122), codes - 96, np.where(codes > 0, 28 + codes % 12, 0))
    out[:, 0] = 27
    out[np.arange(len(units)), (codes > 0).sum(1) + 1] = 27
    return out


def features(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of the subsequences of each unit, normalised; equal codes of a unit are merged, weight 0 fills up."""
    s = _symbols(units)
    width = s.shape[1]
    both = []
    for a, b, c in _STEPS:
        most = width - a - b - c
        if most > 0:
            w, x, y, z = s[:, :most], s[:, a : a + most], s[:, a + b : a + b + most], s[:, a + b + c :]
            code = ((w * SYMBOLS + x) * SYMBOLS + y) * SYMBOLS + z
            both.append(np.where(z > 0, code << 4 | a + b + c + 1, 0))  # with the span in the low bits
    if not both:
        return np.zeros((len(units), 1), np.int32), np.zeros((len(units), 1), np.float32)
    both = np.sort(np.concatenate(both, 1), axis=1)
    code, weight = both >> 4, _POWERS[both & 15]
    first = np.ones(code.shape, dtype=bool)
    first[:, 1:] = code[:, 1:] != code[:, :-1]
    merged = np.zeros(code.shape, dtype=np.float32)
    merged[first] = np.add.reduceat(weight.ravel(), np.flatnonzero(first.ravel()))
    norm = np.sqrt(np.einsum("ij,ij->i", merged, merged))
    return code, merged / np.maximum(norm, 1e-12)[:, None]


#: Margin of a text without units.
FLOOR = -2.0


def worst_two(margins) -> tuple[float, float]:
    """The two largest margins, filled up with FLOOR."""
    first = second = FLOOR
    for m in margins:
        if m > first:
            first, second = m, first
        elif m > second:
            second = m
    return first, second


class SubsequenceMachine:
    """weights: one for each subsequence; a unit's margin is their weighted sum plus bias.

    curve: a text's probability is the logistic curve of (its two worst margins, 1) times curve.
    """

    def __init__(self, weights: np.ndarray, bias: float, curve: tuple[float, float, float] = (4.0, 0.0, 0.0)):
        self.weights, self.bias, self.curve = weights, bias, np.asarray(curve)

    def __getstate__(self) -> tuple:
        """Most weights are 0: only the others are sent."""
        places = np.flatnonzero(self.weights).astype(np.int32)
        return len(self.weights), places, self.weights[places], self.bias, self.curve

    def __setstate__(self, state: tuple) -> None:
        size, places, values, self.bias, self.curve = state
        self.weights = np.zeros(size, dtype=np.float32)
        self.weights[places] = values

    def margins(self, units: list[str]) -> np.ndarray:
        """Margin of each unit; the largest of its windows."""
        if not units:
            return np.zeros(0)
        if len(units) > 20_000:  # bounds what is held at once
            return np.concatenate([self.margins(units[i : i + 20_000]) for i in range(0, len(units), 20_000)])
        parts = [_windows(u) for u in units]
        flat = [w for p in parts for w in p]
        out = np.empty(len(flat))
        by_length = np.argsort([len(w) for w in flat], kind="stable")  # rows of a block have like widths
        for at in range(0, len(flat), 4096):
            rows = by_length[at : at + 4096]
            code, weight = features([flat[i] for i in rows])
            out[rows] = (self.weights[code] * weight).sum(1) + self.bias
        return np.maximum.reduceat(out, np.cumsum([0, *map(len, parts[:-1])]))

    def probability(self, worst) -> np.ndarray:
        """worst: a pair of margins for each text."""
        pairs = np.asarray(worst, dtype=np.float64).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(pairs @ self.curve[:2] + self.curve[2], -30, 30)))


def _linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        gradient = ridge * w - x[on].T @ (cost[on] * y[on] * slack[on])
        hessian = np.diag(ridge) + (x[on] * cost[on, None]).T @ x[on]
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1]


def bag_of(text: str) -> list[str]:
    """The distinct windows of a whole text's units, in order."""
    return sorted({w for u in units_of(text) for w in _windows(u)})


def train(labelled: list[tuple[list[str], int]], landmarks: int = 96, passes: int = 4, seed: int = 7, clean_units: int = 4000, hard_units: int = 2000) -> SubsequenceMachine:
    """A machine from (bag of windows, 0 or 1); without both labels, one that calls nothing toxic.

    clean_units, hard_units: units of clean texts that are counterexamples: so many drawn at first, and
    in every pass so many more of those with the largest margins among all units of clean texts.
    """
    silent = SubsequenceMachine(np.zeros(SYMBOLS**LENGTH, dtype=np.float32), -1.0)
    bags = sorted(labelled)
    toxic, clean = [b for b, y in bags if y and b], [b for b, y in bags if not y]
    if not toxic or not any(clean):
        return silent
    rng = np.random.default_rng(seed)
    rates = [Counter(u for b in part for u in b) for part in (toxic, clean)]
    # A unit that clean texts have about as often as toxic ones is no witness; one that toxic texts have far more often, no counterexample.
    suspect = lambda u: rates[0][u] * len(clean) > 8 * rates[1][u] * len(toxic)
    suspects = [[u for u in bag if suspect(u)] for bag in toxic]
    # First witnesses: the unit with the piece of five symbols that speaks most for the toxic label.
    grams = lambda unit: {f"^{unit}$"[i : i + 5] for i in range(max(1, len(unit) - 2))}
    seen = [Counter(g for b in bag for g in {g for u in b for g in grams(u)}) for bag in (toxic, clean)]
    support = 3 + len(toxic) // 100
    odds = lambda g: np.log((seen[0][g] + 0.5) / (len(toxic) + 1)) - np.log((seen[1][g] + 0.5) / (len(clean) + 1)) if seen[0][g] >= support else 0.0
    known = {u: max(map(odds, grams(u))) for u in sorted({u for b in suspects for u in b})}
    # Where a text has a unit that speaks clearly (odds of 6 to 1), only units that speak nearly as clearly can be witnesses:
    # others merely come along with it, as in long texts or copies of one text.
    clearest = [max(map(known.__getitem__, b), default=0.0) for b in suspects]
    suspects = [[u for u in b if top < np.log(6) or known[u] >= 0.6 * top] for b, top in zip(suspects, clearest, strict=True)]
    # A toxic text answers for every such unit, or else for its worst one.
    telling = lambda b, score, least: [u for u in b if score[u] >= least] or [max(b, key=score.__getitem__)]
    witness = [u for b in suspects if b for u in telling(b, known, np.log(6)) if known[u] > 0]
    if not witness:
        return silent
    pool = sorted(set(rates[1]) - {u for u in witness if suspect(u)})
    negative = [pool[i] for i in rng.permutation(len(pool))[:clean_units]]
    machine, hard = silent, []
    for _ in range(passes):
        common = [u for u, _ in Counter(witness).most_common()]
        spread = [common[i] for i in np.unique(np.linspace(0, len(common) - 1, min(len(common), landmarks)).astype(int))]
        marks = list(dict.fromkeys(common[:landmarks] + spread + hard + negative[:landmarks]))
        # Only the landmarks' own subsequences matter to a kernel with a landmark.
        code, weight = features(marks)
        used = np.unique(code[weight > 0])
        column = np.full(SYMBOLS**LENGTH, -1, dtype=np.int32)
        column[used] = np.arange(len(used))
        base = np.zeros((len(used), len(marks)))
        at, pos = np.nonzero(weight > 0)
        base[column[code[at, pos]], at] = weight[at, pos]
        values, vectors = np.linalg.eigh(base.T @ base)
        root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])

        def describe(units: list[str], column=column, base=base, root=root) -> np.ndarray:
            kernel = np.zeros((len(units), base.shape[1]))
            for begin in range(0, len(units), 256):
                code, weight = features(units[begin : begin + 256])
                at, pos = np.nonzero((weight > 0) & (column[code] >= 0))
                rows, starts = np.unique(at, return_index=True)
                if len(rows):
                    kernel[begin + rows] = np.add.reduceat(base[column[code[at, pos]]] * weight[at, pos][:, None], starts)
            return kernel @ root

        positive = sorted(set(witness))
        weigh = Counter(witness)
        # Frequent witnesses also with one letter put in, for less.
        bent = sorted({u[:i] + chr(97 + int(rng.integers(26))) + u[i:] for u in common[:landmarks] if weigh[u] > 2 for i in range(1, len(u)) for _ in range(2)} - set(pool) - set(positive))
        x = describe(positive + bent + negative)
        y = np.concatenate([np.ones(len(positive) + len(bent)), -np.ones(len(negative))])
        cost = np.concatenate([np.sqrt([weigh[u] for u in positive]), np.full(len(bent), 0.3), np.ones(len(negative))])
        cost[y > 0] *= (y < 0).sum() / cost[y > 0].sum()
        w, bias = _linear_svm(x, y, cost)
        weights = np.zeros(SYMBOLS**LENGTH, dtype=np.float32)
        weights[used] = base @ (root @ w)
        machine = SubsequenceMachine(weights, float(bias))
        margin = machine.margins(pool)
        hard = [pool[i] for i in np.argsort(-margin, kind="stable")[:hard_units]]
        negative, hard = sorted({*negative, *hard}), hard[:landmarks]
        score = dict(zip(every := sorted(known), machine.margins(every), strict=True))
        witness = [u for b in suspects if b for u in telling(b, score, 0.5)]
    # Probabilities: a logistic curve over the two worst margins of each text.
    every = sorted({*rates[0], *rates[1]})
    score = dict(zip(every, machine.margins(every), strict=True))
    m = np.asarray([[*worst_two(score[u] for u in b), 1.0] for b in toxic + clean])
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    curve, ridge = np.zeros(3), np.array([0.1, 0.1, 0.01])
    loss = lambda c: np.logaddexp(0, np.where(y > 0, -1, 1) * (m @ c)).sum() + (ridge * c * c).sum() / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ curve, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag(ridge), m.T @ (p - y) + ridge * curve)
        while loss(curve - step) > loss(curve) and np.abs(step).max() > 1e-9:
            step = step / 2
        curve = curve - step
        if np.abs(step).max() < 1e-9:
            break
    machine.curve = curve
    return machine


def labelled_bags(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str, text: str, label: str, sample_rows: int, sample_bytes: int = 16 << 20) -> DataFrame:
    """(bag of windows, label) of labelled texts, chosen by the key's hash among the rows for which ``learn_from`` holds.

    A key's label is 1 if any of its labels is. Of each label, about sample_rows texts are expected,
    and no more than about sample_bytes of text. Texts become bags on the executors.
    """
    rows = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label")).where(F.col("label").isin(0, 1)).groupBy("key").agg(F.max("label").alias("label"))
    body = docs.where(learn_from).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    known = rows.join(body.select("key", F.octet_length("text").alias("bytes")), "key")
    rates = known.groupBy("label").agg(F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.count(F.lit(1)), F.lit(float(sample_bytes)) / F.greatest(F.sum("bytes"), F.lit(1))).alias("rate"))
    share = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("key")), F.lit(1 << 20)) / float(1 << 20)
    ids = rows.join(F.broadcast(rates), "label").where(share < F.col("rate")).select("key", "label")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([bag_of(x) for x in texts(part.column("text"))], pa.list_(pa.string())), part.column("label").cast(pa.int32())], ["bag", "label"])

    found = body.join(F.broadcast(ids), "key").select("text", "label")  # ids are bounded by the sample
    return found.mapInArrow(bags, "bag array<string>, label int")


def sample_labelled(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str, text: str, label: str, sample_rows: int, sample_bytes: int = 16 << 20) -> list[tuple[list[str], int]]:
    """The rows of labelled_bags, on the driver."""
    return [(r["bag"], r["label"]) for r in labelled_bags(docs, labels, learn_from, key, text, label, sample_rows, sample_bytes).collect()]  # bounded by the sample


def trained(sample: DataFrame, clean_units: int, hard_units: int) -> SubsequenceMachine:
    """What ``train`` makes of a sample (bag, label): trained in one task, as the sample is bounded, so that the driver holds only the machine."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)
        labelled = [row for batch in batches for row in zip(batch.column("bag").to_pylist(), batch.column("label").to_pylist(), strict=True)]
        machine = pickle.dumps(train(labelled, clean_units=clean_units, hard_units=hard_units))
        del labelled
        release()
        yield pa.RecordBatch.from_pydict({"machine": pa.array([machine], pa.binary())})

    found = sample.repartition(1).mapInArrow(learn, "machine binary").collect()
    return pickle.loads(found[0]["machine"]) if found else train([])  # an empty sample may have no task


#: Units whose margins a Python worker keeps.
_KEPT = 100_000


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3, sample_rows: int = 1000, sample_bytes: int = 16 << 20, clean_units: int = 4000, hard_units: int = 2000, label_key: str | None = None) -> DataFrame:
    """Scores every whole text; learns from the labelled rows for which ``learn_from`` holds, and from no others.

    Returns key, score (0 to 1), predicted (1 if score >= threshold), one row for each input row,
    repeated rows and null keys included. A null or empty text has the score of a text without
    units. If one of the labels is missing, no text is called toxic. A key labelled twice counts as
    toxic if any label says so; equal texts have equal scores. Other columns are ignored.
    sample_rows, sample_bytes: expected number of labelled texts of each label learned from, and of their bytes.
    clean_units, hard_units: counterexamples in training, see ``train``.
    label_key: the column of docs and labels that joins them, if it is not key.
    """
    spark = docs.sparkSession
    machine = trained(labelled_bags(docs, labels, learn_from, label_key or key, text, label, sample_rows, sample_bytes), clean_units, hard_units)
    sweep(spark)
    shared = spark.sparkContext.broadcast(machine)
    name = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = resident(f"machine {name}", lambda: (shared.value, {}))
        for part in slices(batches, "text", 1 << 20):
            bags = [words_of(x) for x in texts(part.column("text"))]
            if len(known) > _KEPT:
                known.clear()
            new = [w for w in set().union(*bags) if w not in known]
            known.update(dict.fromkeys(new, FLOOR))
            new = [(w, u) for w in new if (u := plain(w))]
            known.update(zip([w for w, _ in new], m.margins([u for _, u in new]).tolist(), strict=True))
            # Two spellings of one unit in a text are one unit twice, as in two places.
            p = m.probability([worst_two(map(known.__getitem__, b)) for b in bags])
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["key", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(score, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)
