"""Language identification by prediction by partial matching over bytes.

For each language a byte context tree of orders 0 to 3 is counted on a bounded, hash-chosen
sample of labelled texts. A byte that a context has seen costs -log2 of its share; one that it
has not seen costs the escape of that context (distinct / (total + distinct), method C) and is
then coded by the next shorter context, given that it is none of the bytes already excluded;
below order 0, bytes are uniform. Statistics are frozen, so the exact code length of a byte
depends on its last three bytes alone, and it is tabulated once for every context of any tree.
The language with the shortest code for the whole text is predicted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import joined_bytes, resident, slices, texts

ORDER = 3
#: Stands before every text, so that the first bytes have a full context.
_PAD = b"\n" * ORDER
UNDETERMINED = "und"


class CodeLengths:
    """Tables of code lengths; rows: (language, gram of ORDER + 1 bytes, big-endian, count)."""

    def __init__(self, rows: list[tuple[str, int, int]], min_count: int = 2):
        self.languages = sorted({r[0] for r in rows})
        self.alphabet = np.unique(np.concatenate([np.frombuffer(_PAD[:1], np.uint8), *[np.asarray([r[1] >> s & 255 for r in rows], dtype=np.uint8) for s in (24, 16, 8, 0)]])) if rows else np.zeros(0, np.uint8)
        a = len(self.alphabet) + 1  # the last symbol stands for each byte that no sample has
        self.size = a
        self.symbol = np.full(256, a - 1, dtype=np.int64)
        self.symbol[self.alphabet] = np.arange(a - 1)
        if not rows:
            return
        grams = {name: ([], []) for name in self.languages}
        for name, gram, n in rows:
            grams[name][0].append(gram)
            grams[name][1].append(n)
        coded = {}
        for name, (g, n) in grams.items():
            g, n = np.asarray(g, dtype=np.int64), np.asarray(n, dtype=np.float64)
            code = np.zeros(len(g), dtype=np.int64)
            for s in (24, 16, 8, 0):
                code = code * a + self.symbol[g >> s & 255]
            coded[name] = (code, n)
        # Contexts of each order that some tree has; at the top order only those seen min_count times.
        contexts = []
        for k in range(ORDER + 1):
            seen: dict[int, float] = {}
            keys = []
            for code, n in coded.values():
                c, back = np.unique(code // a % a**k, return_inverse=True)
                total = np.bincount(back, weights=n)
                keys.append(c[total >= min_count] if k == ORDER else c)
            contexts.append(np.unique(np.concatenate(keys)))
        starts = np.cumsum([0, *map(len, contexts)])
        # For each language: the distribution of every context, shorter contexts first.
        bits = np.zeros((starts[-1], a, len(self.languages)), dtype=np.float32)
        base = np.full(a, 1 / 256)
        for at, name in enumerate(self.languages):
            code, n = coded[name]
            p = np.zeros((starts[-1], a))
            for k, c in enumerate(contexts):
                below = np.broadcast_to(base, (1, a)) if k == 0 else p[starts[k - 1] + np.searchsorted(contexts[k - 1], c % a ** (k - 1))]
                row = np.searchsorted(c, code // a % a**k)
                row[row == len(c)] = 0
                known = c[row] == code // a % a**k
                count = np.zeros((len(c), a))
                np.add.at(count, (row[known], code[known] % a), n[known])
                has = count > 0
                total, distinct = count.sum(1, keepdims=True), has.sum(1, keepdims=True)
                rest = 1 - (below * has).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    own = count / (total + distinct)
                    escaped = distinct / (total + distinct) * below / np.maximum(rest, 1e-12)
                p[starts[k] : starts[k + 1]] = np.where(total > 0, np.where(has, own, escaped), below)
            bits[:, :, at] = -np.log2(np.maximum(p, 1e-12))
        self.bits = bits.reshape(-1, len(self.languages))
        # The longest known context for every three symbols.
        state = np.zeros(a**ORDER, dtype=np.int32)
        every = np.arange(a**ORDER)
        for k in range(1, ORDER + 1):
            suffix = every % a**k
            row = np.searchsorted(contexts[k], suffix)
            row[row == len(contexts[k])] = 0
            known = contexts[k][row] == suffix
            state[known] = starts[k] + row[known]
        self.state = state

    def lengths(self, values: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        data, offsets = joined_bytes([_PAD + v for v in values])
        s, a = self.symbol[data], self.size
        context = (s[:-3] * a + s[1:-2]) * a + s[2:-1]
        cost = np.zeros((len(s), len(self.languages)), dtype=np.float32)
        cost[ORDER:] = self.bits[self.state[context].astype(np.int64) * a + s[ORDER:]]
        for k in range(ORDER):
            cost[offsets[:-1] + k] = 0
        return np.add.reduceat(cost, offsets[:-1], axis=0, dtype=np.float64)


def _prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def count_grams(docs: DataFrame, key: str, text: str, lang: str, keep: Column, sample_docs: int) -> list[tuple[str, int, int]]:
    """(language, gram, count) over a sample of about ``sample_docs`` texts of each language, chosen by the key's hash."""
    rows = docs.where(keep & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    rates = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.count(F.lit(1))).alias("rate"))
    share = F.pmod(F.xxhash64(F.lit("langid"), F.col("key")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.join(F.broadcast(rates), "lang").where(share < F.col("rate")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            names = np.asarray(part.column("lang").to_pylist(), dtype=object)
            body = texts(part.column("text"))
            for name in sorted(set(names)):
                data = np.frombuffer(b"".join(_PAD + _prepared(body[i]) for i in np.flatnonzero(names == name)), dtype=np.uint8).astype(np.int64)
                gram = ((data[:-3] << 8 | data[1:-2]) << 8 | data[2:-1]) << 8 | data[3:]
                gram, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in grams.collect()]  # bounded by the sample


def identify_languages(docs: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 400, min_count: int = 2) -> DataFrame:
    """Predicts the language of every whole text; learns from the rows for which ``learn_from`` holds.

    Returns key, lang_pred (a learned language; "und" if the text is null or has no letter, or if
    nothing was learned), score (the probability of that language among the learned ones if all
    are equally likely before; 0 for "und") and bits_per_byte. One row for each input row. Ties go
    to the first language by name. sample_docs: expected number of texts of each language learned from.
    min_count: a context of the longest order that was seen less often is left to the next shorter one.
    Letters are characters that Unicode counts as such, so digits, marks and fractions are none.
    """
    rows = count_grams(docs, key, text, lang, learn_from, sample_docs)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(rows)
    name = uuid.uuid4().hex

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = resident(f"code lengths {name}", lambda: CodeLengths(model.value, min_count))
        for part in slices(batches, "text", 1 << 20):
            body = texts(part.column("text"))
            best = np.zeros(len(body), dtype=np.int64)
            score, rate = np.zeros(len(body)), np.zeros(len(body))
            values = [_prepared(x) for x in body]
            if m.languages:
                bits = m.lengths(values)
                best = bits.argmin(1)
                low = bits.min(1)
                score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                rate = low / np.maximum([len(v) for v in values], 1)
            sure = np.asarray([bool(m.languages) and any(map(str.isalpha, x)) for x in body], dtype=bool)
            names = [m.languages[b] if ok else UNDETERMINED for b, ok in zip(best, sure, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(names, pa.string()), pa.array(np.where(sure, score, 0.0)), pa.array(np.where(sure, rate, 0.0))], ["key", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(predict, f"key {kind}, lang_pred string, score double, bits_per_byte double")
    return out.withColumnRenamed("key", key)
