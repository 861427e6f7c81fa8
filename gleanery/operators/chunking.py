"""Chunks from texts: windows, tables, headings and sections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import text as tx

#: Where a window may end, and the share of a window after which it may.
BREAKS = ("\n", ". ", "? ", "다.")
BREAK_AFTER = 0.55


def windows(text: str, most: int, overlap: int) -> list[str]:
    """The pieces of a clean text of at most ``most`` characters.

    A piece that is not the last ends at its last break, if that lies beyond BREAK_AFTER; the next
    begins ``overlap`` characters before its end. A piece always moves on, so overlap must be smaller
    than the shortest piece.
    """
    out, at = [], 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            place = max(text.rfind(b, at, end) for b in BREAKS) - at
            if place > most * BREAK_AFTER:
                end = at + place + 1
        out.append(text[at:end])
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def split_long_text(rows: DataFrame, key: str, text: str, most: int = 900, overlap: int = 120) -> DataFrame:
    """(key, sub_no, piece): the windows of each text, cleaned; empty ones go.

    The walk along a text is sequential, so it runs in Python over Arrow batches; only texts longer
    than a window go there.
    """
    clean = rows.select(F.col(key).alias("key"), tx.clean_text(F.col(text)).alias("text"))
    short = clean.where((F.length("text") > 0) & (F.length("text") <= most)).select("key", F.lit(0).alias("sub_no"), F.col("text").alias("piece"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, pieces = [], [], []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for i, piece in enumerate(windows(t, most, overlap)):
                    keys.append(k)
                    numbers.append(i)
                    pieces.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())], ["key", "sub_no", "piece"])

    kind = clean.schema["key"].dataType.simpleString()
    long = clean.where(F.length("text") > most).mapInArrow(cut, f"key {kind}, sub_no int, piece string").withColumn("piece", tx.clean_text(F.col("piece"))).where("piece <> ''")
    number = F.row_number().over(Window.partitionBy("key").orderBy("sub_no")) - 1
    return short.unionByName(long.withColumn("sub_no", number)).withColumnRenamed("key", key)


def table_markdown(table: Column) -> Column:
    """A table (array of rows of cells) as markdown: empty rows go, short ones are filled up; empty if nothing is left."""
    rows = F.transform(F.filter(table, lambda r: r.isNotNull()), lambda r: F.transform(r, lambda c: tx.clean_text(F.coalesce(c, F.lit("")))))
    rows = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(rows, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    full = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.transform(F.sequence(F.lit(1), width), lambda _: F.lit("---")))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.slice(full, 1, 1), F.array(rule), F.slice(full, F.lit(2), F.size(full))), "\n"))


#: A numbered heading, and a line of a table of contents.
HEADING = r"^(\d{1,2})\.\s+(.+)$"
CONTENTS_START = r"(?i)^Q\s*\d{1,2}\."
CONTENTS_ENTRY = r"(?i)^Q\s*(\d{1,2})\.\s*(.+)$"


def contents_map(lines: DataFrame) -> DataFrame:
    """C4: (page, section_no, title) from the lines (doc, seq, line) of a table of contents.

    An entry begins with "Q n." and runs on to the next; later entries of a number replace earlier ones.
    """
    rows = lines.select("doc", "seq", tx.normalize_space(F.col("line")).alias("line")).where("line <> ''")
    island = F.sum(F.col("line").rlike(CONTENTS_START).cast("int")).over(Window.partitionBy("doc").orderBy("seq"))
    entries = rows.withColumn("entry", island).where("entry > 0").groupBy("doc", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]), " ").alias("text"))
    named = entries.select("doc", "entry", F.regexp_extract("text", CONTENTS_ENTRY, 1).alias("section_no"), tx.heading_title(F.regexp_extract("text", CONTENTS_ENTRY, 2)).alias("title"))
    return named.where((F.length("title") >= 4) & (F.col("section_no") != "")).groupBy("doc", "section_no").agg(F.max_by("title", "entry").alias("title"))


def is_heading(text: Column, contents_title: Column) -> Column:
    """Whether a block is a section's heading; contents_title: the title of its number, or null without such an entry."""
    t = tx.normalize_space(text)
    title = tx.heading_title(F.regexp_extract(t, HEADING, 2))
    a, b = F.array_distinct(F.split(title, "")), F.array_distinct(F.split(contents_title, ""))
    like = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)) >= 0.72
    same = (title == contents_title) | ((title != "") & (F.contains(contents_title, title) | F.contains(title, contents_title))) | like
    fits = t.rlike(HEADING) & ~t.rlike("··|…") & (F.length(t) <= 140)
    return fits & F.when(contents_title.isNotNull(), same).otherwise(~F.contains(tx.heading_title(t), F.lit("다음과같습니다")))


def group_sections(blocks: DataFrame, heading: str = "is_heading", least_text: int = 30, least_body: int = 10) -> DataFrame:
    """Sections of blocks (doc, block_no, text, is_heading): from one heading to the next.

    Returns doc, section_no (from 1), first_block, n_blocks, anchor_text, body. Sections of one
    block, and short ones, go.
    """
    section = F.sum(F.col(heading).cast("int")).over(Window.partitionBy("doc").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0))
    parts = blocks.withColumn("section_no", section).where("section_no > 0")
    grouped = parts.groupBy("doc", "section_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("parts"))
    lines = F.transform("parts", lambda p: p["text"])
    out = grouped.select(
        "doc",
        "section_no",
        F.element_at("parts", 1)["block_no"].alias("first_block"),
        F.size("parts").alias("n_blocks"),
        tx.normalize_space(F.element_at(lines, 1)).alias("anchor_text"),
        F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n").alias("body"),
    )
    return out.where((F.col("n_blocks") >= 2) & (F.length("anchor_text") + F.length("body") + 1 >= least_text) & (F.length("body") >= least_body))


#: Fixed value: an entry of a table of contents with its page.
CONTENTS_LINE = r"(?iU)^\s*Q\s*(\d{1,2})\.\s*(.+?)\s*(?:[·.․…]+\s*)?(\d{1,2})\s*$"


def strip_anchor_lines(text: Column) -> Column:
    """C11: the text's lines that are not blank, without the first if it is a heading or an entry of the contents."""
    lines = F.filter(F.transform(F.split(text, "\n"), tx.clean_text), lambda x: x != "")

    def body(kept: Column) -> Column:
        first = F.get(kept, 0)
        headed = F.coalesce(first.rlike(CONTENTS_LINE) | is_heading(first, F.lit(None).cast("string")), F.lit(False))
        return tx.clean_text(F.array_join(F.when(headed, F.slice(kept, F.lit(2), F.size(kept))).otherwise(kept), "\n"))

    return tx.bound(lines, body)


def filter_ocr(ocr: DataFrame, clean: DataFrame, least: int = 80) -> DataFrame:
    """The OCR chunks (page, ...) of pages whose clean chunks (page, text) have fewer than ``least`` characters."""
    full = clean.groupBy("page").agg(F.sum(F.length("text")).alias("chars")).where(F.col("chars") >= least).select("page")
    return ocr.join(full, "page", "left_anti")
