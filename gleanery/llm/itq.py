"""Near-duplicate vectors by iterative quantisation and hash tables.

A rotation of the centred unit vectors is learned on a bounded sample so that the signs of the
rotated values are balanced and lose little (iterative quantisation); they are a vector's code. Each
table takes its own bits, from further rotations of the same directions, and two vectors meet if
some table has all bits in common. Pairs within ``radius`` bits of the code are then decided by the
cosine of the original vectors, in double precision. Equal vectors are one class with a count, so
copies make no pairs.

A table has about log2(n) bits, so that lists stay short. The number of tables follows from how
often bits differ between vectors at the least cosine, measured on the sample with made partners:
the chance that such a pair meets in no table is at most MISS, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut
from gleanery.llm.graph import connected_components

#: Expected number of vectors from which the rotation is learned.
SAMPLE = 4000
BITS = 64
#: Chance that a pair at the least cosine meets in no table.
MISS = 0.005
#: Pairs at the least cosine that are made to measure how often bits differ.
TRIALS = 4000
#: If so many tables are not enough, they get fewer bits each (longer lists, but no more misses).
MOST_TABLES = 256


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) for unit vectors x: principal directions, then the rotation of least quantisation loss.

    With fewer directions than bits, further bits are random directions.
    """
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    axes = axes[:bits].T
    v = (x - mean) @ axes
    r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
    for _ in range(rounds):
        signs = np.where(v @ r >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(signs.T @ v)
        r = (a @ b).T
    projection = axes @ r
    if projection.shape[1] < bits:
        projection = np.hstack([projection, rng.standard_normal((x.shape[1], bits - projection.shape[1]))])
    return mean, projection


def rotations(n: int, bits: int, seed: int = 5) -> np.ndarray:
    """n random directions, orthogonal within every ``bits`` of them: a matrix of (bits, n)."""
    rng = np.random.default_rng(seed)
    return np.hstack([np.linalg.qr(rng.standard_normal((bits, bits)))[0] for _ in range(-(-n // bits))])[:, :n]


def differing(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, least: float, seed: int = 7) -> tuple[np.ndarray, int]:
    """For unit vectors x and made partners at the cosine ``least``: the share of differing table bits of
    each pair, and the number of differing code bits that all but one in a thousand pairs keep to."""
    rng = np.random.default_rng(seed)
    x = x[np.resize(np.arange(len(x)), max(TRIALS, len(x)))]
    aside = rng.standard_normal(x.shape)
    aside -= np.einsum("ij,ij->i", aside, x)[:, None] * x
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    a, b = ((y - mean) @ projection for y in (x, least * x + math.sqrt(max(0.0, 1 - least * least)) * aside))
    code = ((a >= 0) != (b >= 0)).sum(1)
    turn = rotations(4 * BITS, BITS)
    return ((a @ turn >= 0) != (b @ turn >= 0)).mean(1), int(np.quantile(code, 0.999, method="higher"))


def layout(n: int, differ: np.ndarray) -> tuple[int, int]:
    """(bits of a table, number of tables) for n vectors whose pairs at the least cosine differ in these shares of bits."""
    width = min(BITS // 2, max(8, math.ceil(math.log2(max(n, 2)))))
    while True:
        apart = 1 - (1 - differ) ** width
        tables = next((t for t in range(1, MOST_TABLES + 1) if (apart**t).mean() <= MISS), 0)
        if tables or width == 1:
            return width, tables or MOST_TABLES
        width -= 1


def _matrix(array: pa.Array) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    return np.array(array.flatten(), dtype=np.float64).reshape(len(array), -1)


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, radius: int = 16, sample: int = SAMPLE, planned: int = 0) -> DataFrame:
    """Links of vectors whose cosine is at least ``least``.

    Returns key, n_links (other vectors linked directly, equal ones too), component_id (smallest
    key reachable, itself included), kept (key = component_id): one row for each input row. A
    vector that is null, empty or zero, or has null or non-finite components, is linked with nothing;
    vectors of different lengths are not linked. Keys are integers; other columns are ignored.
    No link below ``least`` is ever returned; a link is missed with a chance of about MISS at most (recall
    is measured in the tests). ``radius`` grows if pairs at the least cosine differ in more bits.
    planned: tables are laid out for so many vectors, if there are fewer.
    """
    spark = vectors.sparkSession
    x = F.col(f"`{vector}`")
    sound = F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.when(sound, F.transform(x, lambda v: v.cast("double") + 0.0)).alias("x"))
    rows = rows.withColumn("d1", F.when(F.col("x").isNotNull(), F.xxhash64("x"))).withColumn("d2", F.when(F.col("x").isNotNull(), F.hash("x", F.size("x"))))
    usable = rows.where("x IS NOT NULL")
    heads = cut(usable.groupBy("d1", "d2").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies"), F.min_by("x", "key").alias("x")))
    parts = []
    for dim in sorted(r[0] for r in heads.select(F.size("x")).distinct().collect()):
        own = heads.where(F.size("x") == dim)
        n = own.count()
        share = F.pmod(F.xxhash64(F.lit("itq"), "id"), F.lit(1 << 20)) / float(1 << 20)
        learned = np.asarray([r[0] for r in own.where(share < sample / n).select("x").collect()] or [own.first()["x"]], dtype=np.float64)  # bounded by the sample
        learned /= np.abs(learned).max(1, keepdims=True)
        learned /= np.linalg.norm(learned, axis=1, keepdims=True)
        mean, projection = learn_rotation(learned, BITS)
        differ, reach = differing(learned, mean, projection, least)
        width, tables = layout(max(n, planned), differ)
        model = (mean, projection, projection @ rotations(width * tables, BITS))
        parts.append(_pairs(own, spark.sparkContext.broadcast(model), width, least, max(radius, reach)))
    links = spark.createDataFrame([], "a long, b long")
    for part in parts:
        links = links.unionByName(part)
    links = cut(links)
    found = connected_components(links)
    # A head's links: its other copies, and all copies of the heads it is linked with.
    counts = heads.select(F.col("id").alias("b"), "copies")
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sums = ends.join(counts, "b").groupBy("a").agg(F.sum("copies").alias("more")).withColumnRenamed("a", "id")
    whole = heads.join(sums, "id", "left").join(found, "id", "left").select("d1", "d2", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.drop("x").join(whole, ["d1", "d2"], "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("key") == component).alias("kept"))


def _pairs(heads: DataFrame, model, width: int, least: float, radius: int) -> DataFrame:
    """Linked pairs (a, b), a < b, of vectors of one length."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projection, turned = model.value
        weights = 1 << np.arange(width, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = _matrix(batch.column("x"))
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                x -= mean
                on = np.packbits(x @ projection >= 0, axis=1, bitorder="little").view(np.int64)[:, 0]
                own = (x @ turned >= 0).reshape(len(x), -1, width) @ weights
                ends = np.arange(len(x) + 1, dtype=np.int32) * own.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(on), pa.ListArray.from_arrays(pa.array(ends), pa.array(own.ravel()))], ["id", "code", "parts"])

    codes = cut(heads.select("id", "x").mapInArrow(encode, "id long, code long, parts array<long>"))
    side = lambda x: codes.select(F.col("id").alias(x), F.col("code").alias(f"c{x}"), F.posexplode("parts").alias("t", "part"))
    met = side("a").join(side("b"), ["t", "part"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= radius))
    pairs = met.select("a", "b").distinct()
    both = pairs.join(heads.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(heads.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                xa, xb = _matrix(batch.column("xa")), _matrix(batch.column("xb"))
                xa, xb = (x / np.abs(x).max(1, keepdims=True) for x in (xa, xb))
                cosine = np.einsum("ij,ij->i", xa, xb) / (np.linalg.norm(xa, axis=1) * np.linalg.norm(xb, axis=1))
                yield batch.select(["a", "b"]).filter(pa.array(cosine >= least))

    return both.select("a", "b", "xa", "xb").mapInArrow(rerank, "a long, b long")
