"""Line deduplication by a deletion-neighbourhood join, with an edit bound of one.

A line occurrence goes if an earlier one (by document key, then line number) has an equal line or
one within one edit. Lines are compared in lower case with white space collapsed. Lines with fewer
than ``min_words`` words go only if they are equal to an earlier one, as one edit can change what a
short line says; those with fewer than ``exact_words`` are left alone.

Two lines within one edit share all but one position: they agree after masking one character at
the same place (substitution), or one of them equals the other with one character deleted. So every
line emits hashed keys of its masked and of its shortened variants; equal keys meet in an
aggregation that keeps the earliest line, so that long groups cost no pairs; the few (line,
earliest) pairs are verified by edit distance on the texts.

Variants are made only where a partner can be: lines within one edit agree outside the block of the
line with the edit. Lines that agree with no other line outside either half are out; the others
are compared in sixteen blocks, and varied only in blocks outside which they agree with another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut, mix64, resident, slices, texts

#: Rows of a side that may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 300_000

#: Blocks of a candidate line; variants are made only in those where an edit can be.
BLOCKS = 16

_ODD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def plain(line: str) -> str:
    return " ".join(line.lower().split())


def line_id(line: str) -> bytes:
    """128 bits, so that different lines have different ids at any size of corpus."""
    return hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=16).digest()


def _block(n: int, j: int, before: str, after: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{n}:{j}:{len(before)}:{before}{after}".encode("utf-8", "replace")) - (1 << 63)


def cuts(n: int, blocks: int) -> list[int]:
    return [n * j // blocks for j in range(blocks + 1)]


def block_keys(line: str, blocks: int) -> list[int]:
    """For each block of the line, a key of all that is outside it.

    First with the line as the shorter of a pair (or of equal length), then as the longer by one;
    blocks are cut by the shorter's length. Lines within one edit agree outside the block with the edit.
    """
    size = len(line)
    out = []
    for n in (size, size - 1):
        c = cuts(n, blocks)
        out += [_block(n, j, line[: c[j]], line[size - (n - c[j + 1]) :]) for j in range(blocks)]
    return out


def variant_keys(line: str, places: list[int], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys and their kinds: 0 the line itself, 1 with one character deleted, 2 with one masked.

    places: indexes into the line's block_keys; only their blocks are varied.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    mask, delete = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    same, longer = cuts(n, blocks), cuts(n - 1, blocks)
    for place in places:
        j = place % blocks
        if place < blocks:
            mask[same[j] : same[j + 1]] = True
        else:
            delete[longer[j] : longer[j + 1] + 1] = True
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _ODD, dtype=np.uint64)]), dtype=np.uint64)
    terms = mix64((codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * powers[:n]
    before = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    rest = before[-1:] - before[1:]
    own = mix64(before[-1:] + np.uint64(n))
    # Deleting either of two equal neighbours gives one variant.
    deleted = np.unique(mix64(before[:-1][delete] + rest[delete] * _INVERSE + np.uint64(n - 1)))
    masked = mix64(mix64(before[:-1] + rest) + (np.arange(n, dtype=np.uint64) << np.uint64(32)) + np.uint64(n) + np.uint64(1 << 63))[mask]
    keys = np.concatenate([own, deleted, masked]).view(np.int64)
    return keys, np.repeat(np.asarray([0, 1, 2], dtype=np.int8), [1, len(deleted), len(masked)])


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _meeting(keys: DataFrame) -> DataFrame:
    """The rows of keys (id, block, ...) whose block another id has too."""
    shared = cut(keys.groupBy("block").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("block"))
    return _semi(keys, shared, "block")


def _semi(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(F.broadcast(ids) if _few(ids) else ids, on, "left_semi")


def _lines(docs: DataFrame, min_words: int, columns: str, row) -> DataFrame:
    """One row for each compared line of documents (key, text): key, line, and what ``row`` makes of the plain lines."""
    names = [c.split()[0] for c in columns.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)
        for part in slices(batches, "text"):
            out: list[list] = [[] for _ in range(2 + len(names))]
            for key, text in zip(part.column("key").to_pylist(), texts(part.column("text")), strict=True):
                for i, line in enumerate(text.split("\n")):
                    line = plain(line)
                    if line.count(" ") >= min_words - 1 and line:
                        for column, value in zip(out, (key, i, *row(line)), strict=True):
                            column.append(value)
            kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
            types = ["long", "int", *[c.split()[1] for c in columns.split(", ")]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(out, types, strict=True)], ["key", "line", *names])

    return docs.mapInArrow(walk, f"key long, line int, {columns}")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 8, exact_words: int | None = None) -> DataFrame:
    """(key, lines): for each document with repeated lines, the numbers (from 0) of those that go, in order.

    Equal lines go from exact_words words on (min_words, if it is null; with 1, every line that is
    not empty), lines within one edit from min_words words on.

    Keys are integers (anything else counts as null). Rows without a key take no part: they lose no
    line, and their lines remove no others. Rows with one key share their decision: of equal line
    numbers under one key, the first counts. Null and empty texts have no lines. Other columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(f"`{key}`").try_cast("long").alias("key"), F.col(f"`{text}`").alias("text")).where("key IS NOT NULL")
    # What each line is, where it stands, and its keys of halves.
    least = min_words if exact_words is None else min(exact_words, min_words)
    rows = cut(_lines(docs, least, "id binary, halves array<long>", lambda line: (line_id(line), block_keys(line, 2) if line.count(" ") >= min_words - 1 else [])))
    at = F.struct("key", "line")
    firsts = cut(rows.groupBy("id").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")))
    # Lines that agree with another one outside a half.
    halves = rows.select("id", F.explode("halves").alias("block"))
    candidates = cut(_meeting(halves).select("id").distinct())
    bodies = _semi(_lines(docs, min_words, "id binary, body string", lambda line: (line_id(line), line)), candidates, "id")
    bodies = cut(bodies.groupBy("id").agg(F.first("body").alias("body")).join(firsts.select("id", "first"), "id"))

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [block_keys(x, BLOCKS) for x in texts(batch.column("body"))]
            again = pa.array(np.repeat(np.arange(batch.num_rows), 2 * BLOCKS))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(again), pa.array(np.tile(np.arange(2 * BLOCKS), batch.num_rows), pa.int32()), pa.array([k for ks in keys for k in ks], pa.int64())], ["id", "place", "block"])

    # Of those, the blocks outside which they agree with another one: only there can the edit be.
    blocks = cut(bodies.select("id", "body").mapInArrow(finer, "id binary, place int, block long"))
    places = _meeting(blocks).groupBy("id").agg(F.collect_set("place").alias("places"))
    varied = bodies.join(places, "id")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body", 1 << 18):
            each = [variant_keys(x, p, BLOCKS) for x, p in zip(texts(part.column("body")), part.column("places").to_pylist(), strict=True)]
            again = pa.array(np.repeat(np.arange(part.num_rows), [len(k) for k, _ in each]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in each])), pa.array(np.concatenate([x for _, x in each])), part.column("id").take(again), part.column("first").take(again)], ["variant", "kind", "id", "first"])

    variants = varied.select("body", "places", "id", "first").mapInArrow(emit, "variant long, kind byte, id binary, first struct<key: long, line: int>")
    own = F.when(F.col("kind") == 0, F.col("first"))
    other = F.when(F.col("kind") > 0, F.col("first"))
    # The earliest line of each kind; only keys that different lines share.
    earliest = variants.groupBy("variant").agg(F.min(own).alias("own"), F.min(other).alias("other"), F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").drop("x", "y")
    met = variants.join(earliest, "variant")
    partner: Column = F.when(F.col("kind") == 1, F.col("own")).otherwise(F.col("other"))
    pairs = met.withColumn("partner", partner).where(F.col("partner") < F.col("first")).select("id", "partner").distinct()
    side = bodies.select(F.col("first").alias("partner"), F.col("body").alias("before"))
    verified = pairs.join(bodies.select("id", "body"), "id").join(side, "partner").where(F.levenshtein("body", "before", 1) >= 0)
    near = cut(verified.select("id").distinct())
    # Kept of a line: its first occurrence, unless a line within one edit stands earlier.
    verdicts = firsts.join(near.withColumn("near", F.lit(True)), "id", "left").where("n > 1 OR near").select("id", "n", F.when(F.col("near").isNull(), F.col("first")).alias("kept"))
    # Lines with a thousandth of all places each are a thousand at most, and broadcast; the others are spread by a shuffle.
    verdicts, every = cut(verdicts), rows.count()
    places = rows.select("id", "key", "line")
    hot = F.broadcast(verdicts.where(F.col("n") * 1000 > every).drop("n"))
    spread = places.join(F.broadcast(verdicts.where(F.col("n") * 1000 > every).select("id")), "id", "left_anti").join(verdicts.where(F.col("n") * 1000 <= every).drop("n"), "id")
    gone = places.join(hot, "id").unionByName(spread).where(F.col("kept").isNull() | (F.col("kept") != at))
    return gone.groupBy("key").agg(F.array_sort(F.collect_set("line")).alias("lines")).withColumnRenamed("key", key)


def _without_lines(docs: DataFrame, key: str, text: str, min_words: int, exact_words: int | None) -> DataFrame:
    """doc (all columns of docs), gone (numbers of lines that go, or null), and body, the text without them."""
    gone = repeated_lines(docs, key, text, min_words, exact_words).select(F.col(f"`{key}`").alias("key"), F.col("lines").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.withColumn("key", F.col("doc").getField(key).try_cast("long")).join(gone, "key", "left")
    kept = F.array_join(F.filter(F.split(F.col("doc").getField(text), "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return rows.select("doc", "gone", F.when(F.col("gone").isNull(), F.col("doc").getField(text)).otherwise(kept).alias("body"))


def _emptied() -> Column:
    """Lines were removed and none of the rest has anything but white space."""
    return F.col("gone").isNotNull() & ~F.col("body").rlike(r"\S")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 8, exact_words: int | None = None) -> DataFrame:
    """All columns of docs, the text without its repeated lines, and n_lines, n_removed and emptied.

    emptied: lines were removed and none of the rest has anything but white space. Columns of docs
    may have any names but those three. Keys and odd rows as in repeated_lines.
    """
    rows = _without_lines(docs, key, text, min_words, exact_words)
    columns = [F.col("body").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns]
    lines = F.split(F.col("doc").getField(text), "\n", -1)
    return rows.select(*columns, F.when(F.col("doc").getField(text).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), _emptied().alias("emptied"))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None, min_words: int = 8, exact_words: int | None = None) -> DataFrame:
    """The rows of docs, without the emptied ones, with their columns, whatever the names: the text without its repeated lines.

    length: a column of the text's length in characters, which is set anew where lines go.
    """
    rows = _without_lines(docs, key, text, min_words, exact_words).where(~F.coalesce(_emptied(), F.lit(False)))
    kinds = {f.name: f.dataType for f in docs.schema.fields}

    def column(c: str) -> Column:
        old = F.col("doc").getField(c)
        if c == text:
            return F.col("body").alias(c)
        return F.when(F.col("gone").isNotNull(), F.length("body").cast(kinds[c])).otherwise(old).alias(c) if c == length else old.alias(c)

    return rows.select(*[column(c) for c in docs.columns])
