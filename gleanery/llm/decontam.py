"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by k = floor(rate * m) edits. Cut into k + 1
pieces, one piece of it must stand in the passage unchanged. All pieces are searched in each whole
text by one automaton; around each hit the item's edit distance to the best passage there is
computed by Myers' bit-parallel method. Items and texts are compared in lower case with white
space collapsed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import resident, slices, texts

#: Share of an item's characters that may differ.
RATE = 0.05
#: UTF-8 bytes of items that are searched at once and sent to every worker; more items make more passes.
BLOCK_BYTES = 8 << 20


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in errors + 1 pieces of nearly equal length, with their places."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> int | None:
    """Smallest edit distance of the pattern to any substring of the text, if at most ``most``."""
    m = len(pattern)
    if not m:
        return 0
    place: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        place[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = place.get(c, 0)
        across = ((eq & up) + up ^ up) | eq
        plus, minus = down | (~(across | up) & full), up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        eq |= down
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (~(eq | plus) & full), plus & eq
        if score < best:
            best = score
    return best if best <= most else None


class ItemSearch:
    """items: (id, plain text) of items that are not empty."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = items
        self.errors = [int(len(t) * rate) for _, t in items]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, t) in enumerate(items):
            for at, piece in pieces(t, self.errors[i]):
                where[piece].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def search(self, text: str) -> dict[int, int]:
        """Distance of every item (by number) that the plain text holds within its errors."""
        windows: dict[int, list[list[int]]] = {}
        if self.empty:
            return {}
        for end, (size, owners) in self.automaton.iter(text):
            for i, at in owners:
                k, m = self.errors[i], len(self.items[i][1])
                start = end + 1 - size - at
                a, b = max(0, start - k), min(len(text), start + m + k)
                spans = windows.setdefault(i, [])
                # Hits come by their ends, so windows of one item come nearly in order; one that lies within the last is not new.
                if spans and a >= spans[-1][0] and a <= spans[-1][0] + k:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
        out = {}
        for i, spans in windows.items():
            item, k = self.items[i][1], self.errors[i]
            for a, b in spans:
                found = myers(item, text[a:b], k)
                if found is not None and found < out.get(i, k + 1):
                    out[i] = found
                if found == 0:
                    break
        return out


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark's items in parts of about block_bytes, by hash."""
    rows = benchmark.select(F.col(f"`{item}`").try_cast("long").alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // block_bytes)
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _searches(benchmark: DataFrame, item: str, text: str, rate: float, block_bytes: int) -> Iterator[Callable[[], ItemSearch]]:
    """For each block of items, a function that gives its automaton on a worker, built once there."""
    sc = benchmark.sparkSession.sparkContext
    for block in _blocks(benchmark, item, text, block_bytes):
        items = sorted({(r["item"], p) for r in block.collect() if (p := plain(r["text"]))})  # bounded by block_bytes
        name = hashlib.md5(repr((items, rate)).encode("utf-8", "replace")).hexdigest()

        def search(shared=sc.broadcast(items), name=name) -> ItemSearch:
            return resident(f"items {name}", lambda: ItemSearch(shared.value, rate))

        yield search


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, item, distance): every item that a document holds within floor(rate * length) edits, once.

    Keys and items are integers (anything else counts as null). Items that are null or empty (but for white space) match nothing,
    null texts hold nothing. Items of one id and several texts count with their smallest distance;
    documents repeated under one key give one row for each repetition. Each pass over the documents
    sends a block of at most about ``block_bytes`` of items to the workers.
    """
    rows = docs.select(F.col(f"`{key}`").try_cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    out = docs.sparkSession.createDataFrame([], f"`{key}` long, `{item}` long, distance int")
    for search in _searches(benchmark, item, item_text, rate, block_bytes):

        def find(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            items = search()
            for part in slices(batches, "text"):
                found = []
                for k, t in zip(part.column("key").to_pylist(), texts(part.column("text")), strict=True):
                    best: dict[int, int] = {}
                    for i, distance in items.search(plain(t)).items():
                        one = items.items[i][0]
                        best[one] = min(distance, best.get(one, distance))
                    found += [(k, i, d) for i, d in best.items()]
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], [key, item, "distance"])

        out = out.unionByName(rows.mapInArrow(find, f"`{key}` long, `{item}` long, distance int"))
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no item within its errors, all columns as they are; nothing is shuffled or joined."""
    for search in _searches(benchmark, item, item_text, rate, block_bytes):

        def keep(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            items = search()
            for part in slices(batches, text):
                yield part.filter(pa.array([not items.search(plain(t)) for t in texts(part.column(text))], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
