"""Shards of nearly equal size by longest-processing-time scheduling.

Rows with equal texts form a group and stay together. Groups larger than a small share of a
shard's load are jobs of their own; their number is bounded by ``shards * split``. All other
groups are dealt by their hash to a fixed number of bundles, and each bundle is one job. Jobs,
largest first, go to the least-loaded shard through a heap on the driver, which holds at most
``shards * split + bundles`` jobs however many rows there are. The same rule holds at every
size: with few groups, nearly every bundle holds one group.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Added to the bytes of each text.
ROW_BYTES = 16


def lpt(jobs: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Shard of each (size, job): the largest first, each to the least-loaded shard; ties by job, then by shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, job in sorted(jobs, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[job] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def lpt_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", split: int = 200, bundles: int = 1 << 14, block_rows: int = 20_000) -> DataFrame:
    """Assigns every row to a shard so that the shards' bytes are nearly equal.

    Returns key, size (UTF-8 bytes of the text plus 16; null: 16), text_crc32, shard, slot (gapless
    from 0 within each shard, by hash block and key). A null text is grouped with the empty ones and
    has their checksum, 0. Repeated rows are rows of their own in one group. Other columns are ignored.
    split: a group of at least 1 / split of a shard's even load is scheduled on its own.
    block_rows: about how many rows of a shard are numbered in one task.
    """
    spark = docs.sparkSession
    body: Column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("group"),
        F.md5(body.cast("binary")).alias("digest"),
    )
    groups = rows.groupBy("group", "digest").agg(F.sum("size").alias("load"))
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total, n = total or 0, n or 0
    bundle = F.pmod(F.col("group"), F.lit(bundles))
    large = F.col("load") * (shards * split) >= F.lit(total)
    jobs = groups.select("load", F.when(large, F.col("digest")).alias("digest"), F.when(~large, bundle).alias("bundle")).groupBy("digest", "bundle").agg(F.sum("load").alias("load"))
    placed = lpt([(r["load"], (r["digest"] or "", -1 if r["bundle"] is None else r["bundle"])) for r in jobs.collect()], shards)  # bounded: see above
    whole = spark.createDataFrame([(d, s) for (d, _), s in placed.items() if d], T.StructType([T.StructField("digest", T.StringType()), T.StructField("large_shard", T.IntegerType())]))
    small = spark.createDataFrame([(b, s) for (d, b), s in placed.items() if not d], T.StructType([T.StructField("bundle", T.LongType()), T.StructField("small_shard", T.IntegerType())]))
    out = rows.withColumn("bundle", bundle).join(F.broadcast(whole), "digest", "left").join(F.broadcast(small), "bundle", "left")
    blocks = max(64, -(-n // block_rows))
    out = out.select("key", "size", "text_crc32", F.coalesce("large_shard", "small_shard").alias("shard"), F.pmod(F.xxhash64(F.lit("slot"), F.col("key")), F.lit(blocks)).alias("block"))
    # Slots: the rows of each (shard, block) are numbered in one task, after those of the blocks before.
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = out.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("shard", "block").orderBy("key", "size", "text_crc32")
    numbered = out.withColumn("rank", F.row_number().over(within)).join(counts.select("shard", "block", "base"), ["shard", "block"])
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))
