"""Sources: tables, chunk files, and texts cut to blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import text as tx

#: A chunk, in the order of its fields; missing fields are null when files are read.
CHUNK = T.StructType(
    [
        T.StructField("chunk_index", T.LongType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("source_title", T.StringType()),
        T.StructField("page", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("locator", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("page_end", T.LongType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("anchor_text", T.StringType()),
        T.StructField("answer_text", T.StringType()),
    ]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines."""
    return spark.read.schema(CHUNK).json(path)


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first path that exists, by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    for path in candidates:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError("none of these exists: " + ", ".join(candidates))


def text_blocks(docs: DataFrame, page: str = "doc_id", title: str = "source", least: int = 10) -> DataFrame:
    """The lines of each document as text chunks, one block each; blocks under ``least`` characters go.

    A document is a page; a block's number is its line's place, from 0.
    """
    lines = docs.select(F.col(page).alias("page"), F.col(title).alias("source_title"), F.posexplode(F.split("text", "\n")).alias("block_no", "raw"))
    blocks = lines.withColumn("text", tx.clean_text(F.col("raw"))).where(F.length("text") >= least)
    return blocks.select(
        (F.col("page") * (1 << 32) + F.col("block_no")).alias("chunk_index"),
        F.concat(F.lit("p"), F.col("page"), F.lit("_text_b"), F.col("block_no"), F.lit("_0")).alias("chunk_id"),
        "source_title",
        "page",
        F.lit("text").alias("kind"),
        "block_no",
        "text",
    )


def block_number(chunk_id) -> F.Column:
    """The block's number in a chunk's id, or null."""
    return F.nullif(F.regexp_extract(chunk_id, r"_text_b(\d+)_", 1), F.lit("")).try_cast("int")


def union_chunks(*parts: DataFrame) -> DataFrame:
    """All chunks, the first of equal ones kept: equal kind and the first 900 characters with white space collapsed."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return distinct_first(out, ["kind", F.substring(tx.normalize_space(F.col("text")), 1, 900)], F.col("chunk_index"))


def distinct_first(rows: DataFrame, keys: list, order) -> DataFrame:
    """Of rows with equal keys, the first in order. An aggregation, so that equal keys in any number meet combined."""
    names = [f"_k{i}" for i in range(len(keys))]
    whole = rows.select(F.struct("*").alias("_row"), order.alias("_at"), *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)])
    return whole.groupBy(*names).agg(F.min_by("_row", "_at").alias("_row")).select("_row.*")
