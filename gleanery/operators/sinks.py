"""Sinks: chunk and answer files, and readable reports as one text for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as tx


def write_chunks(chunks: DataFrame, path: str) -> None:
    """K1: JSON lines."""
    chunks.write.mode("overwrite").json(path)


def write_answers(answers: DataFrame, path: str, by: tuple[str, ...] = ("config",)) -> None:
    """K3, K9: JSON lines, one folder for each configuration."""
    answers.write.mode("overwrite").partitionBy(*by).json(path)


def write_detail_csv(detail: DataFrame, path: str) -> None:
    """K7: CSV; lists are joined by " | "."""
    joined = [F.array_join(c, " | ").alias(c) if kind.startswith("array<string") else F.col(c) for c, kind in detail.dtypes]
    detail.select(*joined).write.mode("overwrite").option("header", True).csv(path)


def debug_block(context: DataFrame, preview: int = 700) -> DataFrame:
    """K4: (qid, block): the context rows (qid, rank, page, kind, score, text) of each question, readable, in order."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] p."), F.col("page").cast("string"), F.lit(" "), F.col("kind"), F.lit(" "), F.format_number("score", 4), F.lit("\n"), F.substring("text", 1, preview))
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return context.groupBy("qid").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("block"))


def ocr_report(chunks: DataFrame, most: int = 50, preview: int = 500) -> DataFrame:
    """K5: one row: number of OCR chunks, their pages, and the first previews in order."""
    ocr = chunks.where(F.col("kind") == "ocr")
    first = ocr.orderBy("chunk_index").limit(most).agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.substring(tx.clean_text(F.col("text")), 1, preview).alias("preview")))).alias("previews"))
    return ocr.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("page")).alias("pages")).crossJoin(F.broadcast(first))  # one row each
