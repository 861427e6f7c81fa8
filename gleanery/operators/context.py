"""Context of retrieved chunks: parents and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def add_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (qid, chunk_index, rank, parent_index) and the parents that are no hits, each by its first hit.

    chunks: chunk_index of every chunk that may be a parent.
    """
    parents = hits.where(F.col("parent_index").isNotNull()).groupBy("qid", F.col("parent_index").alias("chunk_index")).agg(F.min(F.struct("rank", F.col("chunk_index").alias("expanded_from"))).alias("by"))
    parents = parents.join(chunks.select("chunk_index"), "chunk_index", "left_semi").join(hits.select("qid", "chunk_index"), ["qid", "chunk_index"], "left_anti")
    own = hits.select("qid", "chunk_index", "rank", F.col("chunk_index").alias("expanded_from"), F.lit("retrieved").alias("context_type"))
    return own.unionByName(parents.select("qid", "chunk_index", "by.rank", "by.expanded_from", F.lit("parent_section").alias("context_type")))


def expand_neighbors(hits: DataFrame, blocks: DataFrame, window: int = 2, most: int = 28) -> DataFrame:
    """Hits (qid, chunk_index, rank) with the text blocks around them, as many as ``most`` for each query.

    blocks: chunk_index, page, block_no; of several chunks of one block the last counts. The range
    is an equi-join: each hit asks for its 2 * window + 1 block numbers. A hit that is no
    text block stays, without neighbours. A chunk that is a hit itself stays one; a neighbour of several hits belongs to the first.
    """
    last = blocks.groupBy("page", "block_no").agg(F.max("chunk_index").alias("chunk_index"))
    placed = hits.join(blocks, "chunk_index", "left").select("qid", "rank", "chunk_index", "page", "block_no")
    asked = placed.where("block_no IS NOT NULL").select("qid", "rank", F.col("chunk_index").alias("expanded_from"), "page", F.explode(F.sequence(F.col("block_no") - window, F.col("block_no") + window)).alias("block_no"))
    near = asked.join(last, ["page", "block_no"]).withColumn("context_type", F.lit("neighbor"))
    own = placed.withColumn("expanded_from", F.col("chunk_index")).withColumn("context_type", F.lit("retrieved"))
    both = own.unionByName(near)
    first = Window.partitionBy("qid", "chunk_index").orderBy(F.col("context_type").desc(), "rank", "expanded_from")
    both = both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    order = Window.partitionBy("qid").orderBy("rank", "page", "block_no", "chunk_index")
    return both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
