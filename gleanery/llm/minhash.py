"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds its distinct shingles of five words, hashed to 64 bits by one function;
its sketch is the k smallest values. Documents with equal sets (by a 128-bit digest of the whole
set) are one class. Inverted lists run over three neighbouring values of a sketch: of two sets
with a similarity of 0.8 or more, the k smallest values of the union hold three neighbours that both
have, but for a chance of about 0.70 to the power of k, 3.4e-6 for 36 values (0.63 and 1.0e-7 from
0.85 on; never, if both sets fit their sketches).
The union's sketch, made from two sketches, estimates the similarity of a candidate pair, and
pairs that pass are confirmed on the full sets.

Lists can be long where many documents are near copies, so pairs within a list are not all made.
First every document is compared with the most central one of its lists; links found are joined to
components. Documents that have too many shingles to themselves can be linked with nothing and are
out. In a list that still has several components, every document is compared with the list's
centre C and described by its difference from it: the shingles of C that it lacks and those that it
has besides. With m and a of them, two documents A and B share, of c shingles of C and all others,

    |A and B| = c - mA - mB + z,  |A or B| = c + aA + aB - z

where z counts the differences that both have. So a link needs
(100 + percent) z >= sA + sB - (100 - percent) c, with s = 100 m + percent a. With z = 0, that holds
only if both are linked with C, and then they are in one component. Every other link shares at least
that many differences, so it shares one of the first ones in an order that is the same for all, rare
ones first (a prefix filter on differences): documents meet only in lists of such differences. Lists that are still long get a centre of their
own, and the step repeats; pairs of the others are made, filtered by the estimate, and confirmed.
A pair is made only if z can be large enough: at the first difference that both have, z is at most
what each has left of added ones, and of lacking ones, and it is at most half of what their numbers
of differences exceed the bits by in which the parities of their differences in hash bits differ
(a position and a bitmap filter; neither loses a link).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut, joined_bytes, mix64, resident, slices, texts
from gleanery.llm.graph import add_links, connected_components

WORDS = 5
SKETCH = 36
RUN = 3
#: Estimate from which a pair is confirmed; a pair is below it with a chance of 1.3e-5 at a similarity of 0.8, 1.4e-7 at 0.85.
PASS = 0.5
#: Bytes of text that are hashed at once; the arrays of a slice take some fifty times as much.
SLICE = 1 << 20
#: Lists of differences with more documents get a centre of their own, in all turns but the last, which makes all pairs.
LONG_LIST = 1000
TURNS = 3
#: Rounds in which the documents of the other lists are compared with one centre each, before their pairs are made.
STARS = 2
#: Words of 64 bits that hold the parities of a document's differences.
PARITIES = 4
#: Ids that are broadcast to filter documents; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(values: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; a shorter text has one shingle, of all its words."""
    data, offsets = joined_bytes([v.encode("utf-8", "replace") + b" " for v in values])
    data = _LOWER[data]
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in values]
    last = ~space
    last[:-1] &= space[1:]
    sizes = np.flatnonzero(last) - starts + 1
    # Hash of a word: its bytes' random values times powers of an odd number, summed, with its length.
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    powers = np.cumprod(np.full(int(sizes.max()) + 1, _ODD, dtype=np.uint64))
    terms = np.where(space, np.uint64(0), _BYTE[data] * powers[np.where(space, 0, place)])
    word = mix64(np.add.reduceat(terms, starts) + sizes.astype(np.uint64))
    count = np.diff(np.searchsorted(starts, offsets))
    bounds = np.concatenate([[0], np.cumsum(count)])
    full = np.zeros(len(word), dtype=np.uint64)
    for k in range(min(words, len(word))):
        full[: len(word) - k] = mix64(full[: len(word) - k] + word[k:] * np.uint64(2 * k + 1) + np.uint64(k))
    out = []
    for i, n in enumerate(count):
        at = bounds[i]
        if n >= words:
            out.append(np.unique(full[at : at + n - words + 1]))
        elif n:
            short = np.full(1, n, dtype=np.uint64)
            for j in range(at, at + n):
                short = mix64(short + word[j : j + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _lists(sets: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64), pa.int64()))


def sketches(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """key, n_shingles, the set's digest (d1, d2; null for an empty set) and the sketch, of documents (key, text)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)
        for part in slices(batches, "text", SLICE):
            sets = shingle_sets(texts(part.column("text")))
            d1 = [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
            d2 = [int(np.bitwise_xor.reduce(mix64(s + _ODD)).view(np.int64)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists([s[:k] for s in sets])], ["key", "n_shingles", "d1", "d2", "sketch"])

    return docs.mapInArrow(sketch, "key long, n_shingles long, d1 long, d2 long, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """key and the whole set, of documents (key, text)."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)
        for part in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([part.column("key"), _lists(shingle_sets(texts(part.column("text"))))], ["key", "hashes"])

    return docs.mapInArrow(full, "key long, hashes array<long>")


def with_ids(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose key is (or with left_anti is not) in ids: by broadcast where ids are few, else by a shuffled join."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


def _near(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the union's k smallest values that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(_unsigned(a), _unsigned(b))), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(_unsigned(a), _unsigned(b)))) / F.size(union)


def _unsigned(x: Column) -> Column:
    """Signed 64-bit values in the order of the unsigned ones."""
    return F.transform(x, lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))


def _estimated(pairs: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """Of pairs (a, b), those whose estimate is high enough to be confirmed."""
    side = lambda x: heads.select(F.col("key").alias(x), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_estimate(F.col("sa"), F.col("sb"), k) >= PASS).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets (key, hashes) reach the similarity."""
    both = pairs.join(sets.withColumnsRenamed({"key": "a", "hashes": "ha"}), "a").join(sets.withColumnsRenamed({"key": "b", "hashes": "hb"}), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(common * 100 >= (F.size("ha") + F.size("hb") - common) * percent).select("a", "b")


def _placed(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of lists (value, key, ...) with their component, of lists that have more than one."""
    placed = lists.drop("component").join(parts.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = placed.groupBy("value").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("value")
    return placed.join(mixed, "value", "left_semi")


def _linkable(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of lists with left, the number of shingles that another document of ``sets`` has.

    No other shingle can be shared, so documents with too few of them can be linked with nothing, and go.
    """
    single = sets.select("key", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key = other")
    alone = single.groupBy("key").agg(F.count(F.lit(1)).alias("alone"))
    able = placed.join(alone, "key", "left").withColumn("left", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return able.where(F.col("left") * 100 >= F.col("n") * percent)


def _fits(na: str, nb: str, la: str, lb: str, percent: int) -> Column:
    """Whether two sets of sizes na and nb may be linked if at most la and lb of them can be shared."""
    most = F.least(la, lb)
    return most * 100 >= (F.col(na) + F.col(nb) - most) * percent


def _differences(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every document with the centre of each of its lists: (centre, key, c, s, d, n_added, near, n, left, degree).

    d: the differences, those that the centre has last, as more documents lack them than have any of the
    others, each part in one order for all documents; near: whether the two are linked, by their full sets.
    """
    best = F.max(F.struct((F.col("left") / F.col("n")).alias("share"), "degree", (-F.col("key")).alias("key")))
    centre = lists.groupBy("value").agg(best.alias("best")).select("value", (-F.col("best.key")).alias("centre"))
    pairs = lists.join(centre, "value").where("key <> centre").select("centre", "key", "n", "left", "degree").distinct()
    both = pairs.join(sets.withColumnsRenamed({"key": "centre", "hashes": "hc"}), "centre").join(sets, "key")
    both = both.select("centre", "key", "n", "left", "degree", F.size("hc").cast("long").alias("c"), F.array_except("hc", "hashes").alias("missing"), F.array_except("hashes", "hc").alias("added"))
    both = both.withColumn("s", 100 * F.size("missing").cast("long") + percent * F.size("added").cast("long"))
    return both.select("centre", "key", "c", "s", F.concat(F.sort_array("added"), F.sort_array("missing")).alias("d"), F.size("added").alias("n_added"), (F.col("s") <= (100 - percent) * F.col("c")).alias("near"), "n", "left", "degree")


def _parities(values: Column) -> list[Column]:
    """For each of PARITIES * 64 classes of values, whether an odd number of them is in it, as words of bits."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    word = lambda x: F.shiftright(x, 6).bitwiseAND(PARITIES - 1)
    flip = lambda w: lambda acc, x: F.when(word(x) == w, acc.bitwiseXOR(bit(x))).otherwise(acc)
    return [F.aggregate(values, F.lit(0).cast("long"), flip(w)).alias(f"p{w}") for w in range(PARITIES)]


def _rare(differences: DataFrame, parts: DataFrame, percent: int, bounds: bool) -> DataFrame:
    """Lists (value, key, ...) of the differences that a document must share one of with any partner still to be found.

    far and wide: a partner may be one that is not linked with the centre, or is; a linked one has only partners that are not.
    """
    rows = differences.join(parts.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    about = rows.groupBy("centre").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(F.when(F.col("near"), F.col("s"))).alias("least_near"), F.min(F.when(F.col("near"), F.col("component"))).alias("own"), F.min(F.when(~F.col("near"), F.col("s"))).alias("least_far"))
    rows = rows.join(about.where("x < y").drop("x", "y"), "centre")
    # Differences that two documents must share: all but so many minus one, in one order for all, hold one of them.
    shared = lambda least: F.greatest(F.lit(1), F.ceil((F.col("s") + F.col(least) - (100 - percent) * F.col("c")) / (100 + percent)))
    reach = lambda least: F.when(F.col(least).isNull(), 0).otherwise(F.size("d") - shared(least) + 1).cast("int")
    rows = rows.withColumn("far", reach("least_far")).withColumn("wide", F.when(F.col("near") | (F.col("component") == F.col("own")), 0).otherwise(reach("least_near"))).where("far > 0 OR wide > 0")
    parities = [f"p{w}" for w in range(PARITIES)] if bounds else []
    own = ["c", "s", "nd", "n_added", *parities] if bounds else []
    rows = rows.select("*", F.size("d").alias("nd"), *_parities(F.col("d"))) if bounds else rows
    each = rows.select("centre", "key", "near", "component", "far", "wide", "n", "left", "degree", *own, F.posexplode(F.slice("d", F.lit(1), F.greatest("far", "wide"))).alias("place", "element"))
    # What is left of the added and of the lacking ones from this difference on, itself included.
    ahead = [F.greatest(F.col("n_added") - F.col("place"), F.lit(0)).alias("added"), (F.col("nd") - F.greatest("place", "n_added")).alias("missing")]
    own = ["c", "s", "nd", *ahead, *parities] if bounds else []
    each = each.select(F.xxhash64("centre", "element").alias("value"), "key", "component", "near", (F.col("place") < F.col("far")).alias("far"), (F.col("place") < F.col("wide")).alias("wide"), "n", "left", "degree", *own)
    several = each.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("value")
    return each.join(several, "value", "left_semi")


def _met(lists: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of two tables of lists of rare differences (columns with _a and _b): in different components, and possibly linked."""
    parities = [f"p{w}" for w in range(PARITIES)]
    bounds = "nd" in lists.columns
    columns = ("key", "component", "near", "far", "wide", "n", "left", *(("c", "s", "nd", "added", "missing", *parities) if bounds else ()))
    side = lambda rows, x: rows.select("value", *[F.col(c).alias(f"{c}_{x}") for c in columns])
    meet = F.when(F.col("near_a") == F.col("near_b"), F.col("far_a") & F.col("far_b") & ~F.col("near_a")).when(F.col("near_a"), F.col("far_a") & F.col("wide_b")).otherwise(F.col("wide_a") & F.col("far_b"))
    # Shared differences that the pair needs, and two bounds of those that it can have.
    needed = F.col("s_a") + F.col("s_b") - (100 - percent) * F.col("c_a")
    ahead = F.least("added_a", "added_b") + F.least("missing_a", "missing_b")
    apart_bits = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in parities), F.lit(0))
    can = (needed <= (100 + percent) * ahead) & (2 * needed <= (100 + percent) * (F.col("nd_a") + F.col("nd_b") - apart_bits))
    both = side(lists, "a").join(side(others, "b"), "value")
    return both.where((F.col("component_a") != F.col("component_b")) & meet & (can if bounds else F.lit(True)) & _fits("n_a", "n_b", "left_a", "left_b", percent))


def _stars_of(lists: DataFrame, heads: DataFrame, percent: int, k: int) -> DataFrame:
    """At most one pair (a, b) for each document b of lists of rare differences, with the centre that it meets in most lists.

    A list's centre is the document in most of the lists. Near copies of each other that are far from the
    centre of the lists before come into one component by these pairs, and need no others.
    """
    at = lists.drop("degree").join(lists.groupBy("key").agg(F.count(F.lit(1)).alias("degree")), "key")
    centre = at.groupBy("value").agg(F.max(F.struct("degree", (-F.col("key")).alias("key"))).alias("most")).select("value", (-F.col("most.key")).alias("key"))
    met = _met(lists.join(centre, ["value", "key"]), lists, percent).groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy(F.col("key_b").alias("b")).agg(F.max(F.struct("n", (-F.col("key_a")).alias("a"))).alias("best"))
    return _estimated(best.select((-F.col("best.a")).alias("a"), "b"), heads, k)


def _pairs_of(lists: DataFrame, heads: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (a, b) of lists of rare differences: in different components, possibly linked, and with a high estimate."""
    made = _met(lists, lists, percent).where("key_a < key_b")
    return _estimated(made.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct(), heads, k)


def _remaining_links(lists: DataFrame, parts: DataFrame, heads: DataFrame, docs: DataFrame, percent: int, k: int, rounds: int) -> DataFrame:
    """The components once all links between documents of one list are in them."""
    placed = cut(_placed(lists, parts))
    ids = placed.select("key").distinct()
    sets = cut(full_sets(with_ids(docs, ids, "key")))
    lists = cut(_placed(_linkable(placed, sets, percent), parts))
    for turn in range(TURNS):
        differences = cut(_differences(lists, sets, percent))
        rare = cut(_rare(differences, parts, percent, rounds > 0))
        sizes = rare.groupBy("value").agg(F.count(F.lit(1)).alias("size"))
        long = cut(sizes.where(F.col("size") > LONG_LIST).select("value")) if turn < TURNS - 1 else None
        again = long is not None and long.limit(1).count() > 0
        short = rare.join(long, "value", "left_anti") if again else rare
        links = differences.where("near").select(F.col("centre").alias("a"), F.col("key").alias("b"))
        for _ in range(rounds):
            parts = add_links(parts, links.unionByName(_confirmed(_stars_of(short, heads, percent, k), sets, percent)))
            links, short = links.limit(0), cut(_placed(short, parts))
        parts = add_links(parts, links.unionByName(_confirmed(_pairs_of(short, heads, percent, k), sets, percent)))
        if not again:
            break
        lists = cut(_placed(rare.join(long, "value", "left_semi"), parts))
    return parts


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, k: int = SKETCH, rounds: int = STARS) -> DataFrame:
    """Classes of documents linked by 100 * |intersection| >= percent * |union| of their shingle sets.

    Returns key, n_shingles, component_id (smallest key reachable by links, itself included), kept
    (key = component_id): one row for each input row. A text without words, or null, is linked with
    nothing. Keys are integers (anything else counts as null); a row without a key is linked with nothing,
    has no component, and is kept. Repeated rows have equal sets and so one component; a
    key with different texts has one row for each, with the class of that text.
    rounds: how often documents are compared with one centre each before pairs are made; with 0, and
    without the bounds on z, lists take less disk and make more pairs. The result is the same.
    Other columns are ignored, an empty table gives no rows. The sketches are written to the checkpoint folder.
    """
    docs = docs.select(F.col(f"`{key}`").try_cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = cut(sketches(docs, k))
    docs = docs.where("key IS NOT NULL")
    sets = rows.where("n_shingles > 0 AND key IS NOT NULL")
    # One head for each distinct set.
    heads = cut(sets.groupBy("d1", "d2", "n_shingles").agg(F.min("key").alias("key"), F.min_by("sketch", "key").alias("sketch")))
    values = F.transform(F.sequence(F.lit(1), F.size("sketch") - RUN + 1), lambda i: F.xxhash64(*[F.element_at("sketch", i + j) for j in range(RUN)]))
    lists = heads.where(F.size("sketch") >= RUN).select("key", F.col("n_shingles").alias("n"), F.explode(F.array_distinct(values)).alias("value"))
    # First pass: each document with the most central one of its lists, that is the one in most shared lists.
    shared = lists.join(lists.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("value"), "value", "left_semi")
    shared = cut(shared.join(shared.groupBy("key").agg(F.count(F.lit(1)).alias("degree")), "key"))
    centre = shared.groupBy("value").agg(F.max(F.struct("degree", (-F.col("key")).alias("key"), "n")).alias("c")).select("value", (-F.col("c.key")).alias("a"), F.col("c.n").alias("na"), F.col("c.degree").alias("da"))
    stars = shared.join(centre, "value").where((F.col("key") != F.col("a")) & _near(F.col("n"), F.col("na"), percent))
    stars = stars.groupBy(F.col("key").alias("b")).agg(F.max(F.struct("da", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    stars = cut(_estimated(stars, heads, k))
    ids = stars.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    parts = connected_components(_confirmed(stars, full_sets(with_ids(docs, ids, "key")), percent))
    # Then all other links within lists that have documents of several components.
    parts = _remaining_links(shared, parts, heads, docs, percent, k, rounds)
    # Every set's component, and then every row's.
    whole = heads.select("d1", "d2", "n_shingles", "key").join(parts.withColumnRenamed("id", "key"), "key", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "key").alias("component"))
    out = rows.drop("sketch").join(whole, ["d1", "d2", "n_shingles"], "left").select("key", "n_shingles", F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))
