"""Units of answers: cut, scored, selected and rendered."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import lexicon as lx
from gleanery.functions import text as tx

#: A line that begins with a short label, and the ends of sentences at which long units are packed anew.
LABEL_LINE = r"^\s*[A-Z]?[\[\(]?.{0,12}[:：]"
SENTENCE_END = r"(?<=[다요]\.)\s+"


def _packed(parts: Column, most: int) -> Column:
    """Neighbouring sentences joined while they fit: array of units."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, part: Column) -> Column:
        fits = (acc["open"] != "") & (F.length(acc["open"]) + F.length(part) + 1 <= most)
        done = F.when((acc["open"] == "") | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat(acc["open"], F.lit(" "), part)).otherwise(part).alias("open"))

    return F.aggregate(parts, empty, add, lambda acc: F.concat(acc["done"], F.filter(F.array(acc["open"]), lambda x: x != "")))


def answer_units(rows: DataFrame, key: str, text: str, most: int = 1500) -> DataFrame:
    """(key, unit_no, unit): the lines of each text grouped to units, long ones packed or cut, first of equal ones.

    A unit begins at a bullet or number, or at a short labelled line after others.
    """
    lines = rows.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).withColumn("line", tx.clean_text(F.col("raw"))).where("line <> ''")
    own = Window.partitionBy("key").orderBy("line_no")
    labelled = F.col("line").rlike(LABEL_LINE) & (F.length("line") < 600) & (F.row_number().over(own) > 1)
    lines = lines.withColumn("starts", F.col("line").rlike(lx.UNIT_START) | labelled)
    lines = lines.withColumn("group", F.sum(F.col("starts").cast("int")).over(own))
    units = lines.groupBy("key", "group").agg(tx.normalize_space(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), " ")).alias("unit"))
    list_like = (tx.list_signal(F.col("unit")) >= 1.2) | F.col("unit").rlike(",|，|http")
    sentences = F.filter(F.transform(F.split("unit", SENTENCE_END), tx.normalize_space), lambda x: x != "")
    parts = F.when((F.length("unit") > most) & ~list_like, _packed(sentences, most)).otherwise(F.array(F.regexp_replace(F.substring("unit", 1, most), r"(?U)\s+$", "")))
    units = units.select("key", "group", F.posexplode(parts).alias("part", "unit")).where("unit <> ''")
    first = units.groupBy("key", "unit").agg(F.min(F.struct("group", "part")).alias("at"))
    return first.select(F.col("key").alias(key), (F.row_number().over(Window.partitionBy("key").orderBy("at")) - 1).alias("unit_no"), "unit")


def similarity(a: str, b: str, containment: bool = True) -> float:
    """F18 for canonical texts: 0 if one is empty, 1 for containment, else the larger of bigram Jaccard and matching ratio."""
    if not a or not b:
        return 0.0
    if containment and (a in b or b in a):
        return 1.0
    left, right = ({x} if len(x) < 2 else set(map("".join, zip(x, x[1:], strict=False))) for x in (a, b))
    both = len(left.intersection(right))
    return max(both / (len(left) + len(right) - both), SequenceMatcher(None, a, b).ratio())


def dedupe_units(units: DataFrame, least: float = 0.88, most: int = 24) -> DataFrame:
    """Of the units of a question (qid, unit_no, kind, role, text, score), those unlike any better one.

    Greedy in the order of unit_priority, and similarity is not transitive, so a question's units
    are handled together: at most its ``most`` best by score, as a question is shown no more.
    """
    ranked = units.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "unit_no"))).where(F.col("n") <= most).drop("n")
    rows = ranked.withColumn("priority", tx.unit_priority(F.col("kind"), F.col("role"), F.col("text"), F.col("score"))).withColumn("key", tx.canonical(F.col("text")))
    rows = rows.select("qid", "unit_no", "key", *[F.col(f"priority.{x}").alias(f"p_{x}") for x in ("kind", "role", "length", "score")])

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, str]] = []
        for row in group.sort_values(["p_kind", "p_role", "p_length", "p_score", "unit_no"]).itertuples():
            if not any(row.key == k or similarity(row.key, k) >= least for _, k in kept):
                kept.append((row.unit_no, row.key))
        return pd.DataFrame({"qid": group["qid"].iloc[:1].repeat(len(kept)).values, "unit_no": [n for n, _ in kept]})

    kept = rows.groupBy("qid").applyInPandas(keep, "qid long, unit_no long")
    return ranked.join(kept, ["qid", "unit_no"], "left_semi")


def prefer_clean(units: DataFrame) -> DataFrame:
    """The units (qid, question, kind, text, ...) that an answer may use, with clean_reason.

    Noisy OCR units go where a clean unit exists; all OCR units go where a clean one lists enough,
    covers the critical terms, or overlaps with the question.
    """
    clean, ocr = tx.is_clean_source(F.col("kind")), F.col("kind") == "ocr"
    noisy = ocr & tx.is_noisy(F.col("text"))
    any_of = lambda x: F.max(F.coalesce(x, F.lit(False))).over(Window.partitionBy("qid"))
    terms = tx.critical_terms(F.col("question"))
    rows = units.withColumns({"_clean": clean, "_noisy": noisy, "_ocr": ocr})
    rows = rows.withColumns({"_has_clean": any_of(F.col("_clean")), "_had_noisy": any_of(F.col("_noisy"))}).where(~(F.col("_noisy") & F.col("_has_clean")))
    enough = F.size(tx.list_items(F.col("text"))) >= F.coalesce(tx.requested_count(F.col("question")), F.lit(2))
    rows = rows.withColumns(
        {
            "_list": F.col("_clean") & enough,
            "_cover": F.col("_clean") & tx.contains_all(F.col("text"), terms),
            "_overlap": F.col("_clean") & (tx.query_overlap(F.col("question"), F.col("text")) > 0),
            "_is_list": tx.intent(F.col("question")) == "list",
            "_has_ocr": any_of(F.col("_ocr")),
        }
    )
    rows = rows.withColumns({f"_any{x}": any_of(F.col(x)) for x in ("_list", "_cover", "_overlap")})
    reason = (
        F.when(~F.col("_has_ocr"), F.when(F.col("_had_noisy") & F.col("_has_clean"), "dropped_noisy_ocr_units").otherwise("no_ocr_selected"))
        .when(~F.col("_has_clean"), "ocr_only")
        .when(F.col("_is_list"), F.when(F.col("_any_list"), "clean_list_unit_available").otherwise("no_clean_list_unit"))
        .when(F.col("_any_cover"), "clean_unit_covers_critical_terms")
        .when(F.col("_any_overlap"), "clean_unit_has_query_overlap")
        .otherwise("no_clean_replacement")
    )
    rows = rows.withColumn("clean_reason", reason)
    fits = (
        F.when(F.col("clean_reason") == "clean_list_unit_available", F.col("_list"))
        .when(F.col("clean_reason") == "clean_unit_covers_critical_terms", F.col("_cover"))
        .when(F.col("clean_reason") == "clean_unit_has_query_overlap", F.col("_overlap"))
        .otherwise(True)
    )
    return rows.where(fits).select(*units.columns, "clean_reason")


def choose_units(units: DataFrame) -> DataFrame:
    """The units (qid, question, unit_no, kind, role, text, score) of the final answer, by the kind of question.

    One for a list or a yes-or-no question, six for a procedure, two otherwise.
    """
    question, text, kind = F.col("question"), F.col("text"), F.col("kind")
    style, overlap, n = tx.intent(question), F.round(tx.query_overlap(question, text), 9), F.length(tx.clean_unit(text))
    clean = tx.is_clean_source(kind)
    key = (
        F.when(style == "list", F.array(F.when(clean, 0.0).otherwise(1.0), -F.round(tx.list_signal(text), 9), -overlap, n.cast("double")))
        .when(style == "availability", F.array(F.when(clean, 0.0).otherwise(1.0), tx.is_unacceptable_ocr(kind, text).cast("double"), -overlap, n.cast("double")))
        .otherwise(F.array(F.lit(0.0)))
    )
    most = F.when(style.isin("list", "availability"), 1).when(style == "procedure", 6).otherwise(2)
    rows = units.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(key, "unit_no")))
    return rows.withColumn("answer_style", style).where(F.col("place") <= most)


def ocr_support(units: DataFrame, most: int = 3, preview: int = 500) -> DataFrame:
    """Of a question's OCR units (qid, question, unit_no, kind, text), the first by overlap, short ones first, as supporting evidence."""
    rows = units.where(F.col("kind") == "ocr").withColumn("quote_preview", tx.clean_unit(F.col("text")))
    order = Window.partitionBy("qid").orderBy(F.round(tx.query_overlap(F.col("question"), F.col("text")), 9).desc(), F.length("quote_preview"), "unit_no")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return rows.withColumns({"quote_preview": F.substring("quote_preview", 1, preview), "ocr_noise_ratio": tx.noise_ratio(F.col("text")), "ocr_quality_score": tx.ocr_quality(F.col("text"))})


def render_answers(chosen: DataFrame) -> DataFrame:
    """One row for each question of its chosen units (qid, question, place, text): final_answer, mode and quotes.

    A list question shows the items of its first unit; others show all units, cleaned and joined.
    """
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    rows = chosen.groupBy("qid", "question").agg(F.transform(parts, lambda p: p["text"]).alias("quotes"))
    listed = tx.render_list(F.col("question"), F.element_at("quotes", 1))
    joined = tx.normalize_space(F.array_join(F.transform("quotes", tx.clean_unit), " "))
    is_list = tx.is_list_style(F.col("question"))
    return rows.select("qid", "question", F.when(is_list, listed["answer"]).otherwise(joined).alias("final_answer"), F.when(is_list, listed["mode"]).otherwise("unit_extract").alias("mode"), "quotes")


def within_budget(units: DataFrame, budget: int, overhead: int = 0, least: int = 3) -> DataFrame:
    """U4: the first units (qid, rank, text) whose summed token estimates fit the budget; ``least`` stay even beyond it."""
    total = F.sum(tx.token_estimate(F.col("text"))).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) + overhead
    return units.withColumn("tokens_to_here", total).where((F.col("tokens_to_here") <= budget) | (F.col("rank") <= least))


def coverage(answers: DataFrame, question: str = "question", answer: str = "final_answer") -> DataFrame:
    """Adds missing_terms, required_min_items, rendered_item_count, ok and reason."""
    q, a = F.col(question), tx.normalize_space(F.col(answer))
    missing = F.filter(tx.critical_terms(q), lambda t: ~F.contains(tx.normalize_for_tokenize(a), tx.normalize_for_tokenize(t)))
    is_list = tx.intent(q) == "list"
    rows = answers.withColumns(
        {
            "missing_terms": missing,
            "required_min_items": F.when(is_list, F.coalesce(tx.requested_count(q), F.lit(2))).otherwise(F.coalesce(tx.requested_count(q), F.lit(0))),
            "rendered_item_count": F.when(is_list, tx.rendered_items(a)).otherwise(0),
        }
    )
    few = is_list & (F.col("rendered_item_count") < F.col("required_min_items"))
    return rows.withColumns({"ok": (F.size("missing_terms") == 0) & ~few, "reason": F.when(few, "not_enough_list_items").when(F.size("missing_terms") > 0, "missing_critical_terms").otherwise("ok")})
