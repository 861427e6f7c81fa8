"""Evaluation of answers against gold requirements, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as tx


def completeness(answer: Column, requirements: Column) -> Column:
    """V2: percentage of requirements (array of struct(label, aliases)) of which the answer has an alias."""
    hits = F.filter(requirements, lambda r: tx.alias_hit(answer, r["aliases"]))
    return F.when(F.size(requirements) == 0, 0.0).otherwise(F.size(hits) / F.size(requirements) * 100.0)


def evidence_text(evidence: Column) -> Column:
    """V1: quotes, titles and locators of evidence (array of struct(quote, title, page, locator)) as one text."""
    return F.array_join(F.flatten(F.transform(evidence, lambda e: F.array(*[F.coalesce(e[x], F.lit("")) for x in ("quote", "title", "locator")]))), "\n")


def evidence_pages(evidence: Column) -> Column:
    """V1: pages named by evidence, in its page or its locator."""
    return F.array_distinct(F.flatten(F.transform(evidence, lambda e: F.concat(tx.page_spec(F.coalesce(e["page"], F.lit(""))), tx.page_spec(F.coalesce(e["locator"], F.lit("")))))))


def hit_rate(evidence: Column, requirements: Column, strict: bool = False) -> Column:
    """V3: percentage of requirements (array of struct(pages, aliases)) that the evidence meets.

    Page and alias may come from different pieces; with strict, one piece must have both, by its page alone.
    """
    page_ok = lambda r, pages: (F.size(r["pages"]) == 0) | F.arrays_overlap(r["pages"], pages)
    if strict:
        met = lambda r: F.exists(evidence, lambda e: page_ok(r, tx.page_spec(F.coalesce(e["page"], F.lit("")))) & tx.alias_hit(F.coalesce(e["quote"], F.lit("")), r["aliases"]))
    else:
        pooled = F.struct(evidence_text(evidence).alias("text"), evidence_pages(evidence).alias("pages"))
        count = tx.bound(pooled, lambda p: F.size(F.filter(requirements, lambda r: page_ok(r, p["pages"]) & tx.alias_hit(p["text"], r["aliases"]))))
        return F.when(F.size(requirements) == 0, 0.0).otherwise(count / F.size(requirements) * 100.0)
    return F.when(F.size(requirements) == 0, 0.0).otherwise(F.size(F.filter(requirements, met)) / F.size(requirements) * 100.0)


def evaluate(cases: DataFrame, results: DataFrame) -> DataFrame:
    """V4: one row for each case (id, answer_requirements, evidence_requirements) and version of results.

    results: version, id, seq, answer, evidence, seconds; of several results of one id the last counts.
    A version without a result for a case gets 0 there.
    """
    last = results.groupBy("version", "id").agg(F.max_by(F.struct("answer", "evidence", "seconds"), "seq").alias("r"))
    every = cases.crossJoin(F.broadcast(results.select("version").distinct()))  # versions are few
    rows = every.join(last, ["version", "id"], "left")
    evidence = F.coalesce(F.col("r.evidence"), F.array().cast("array<struct<quote:string,title:string,page:string,locator:string>>"))
    answer = F.coalesce(F.col("r.answer"), F.lit(""))
    return rows.select(
        "version",
        "id",
        answer.alias("answer"),
        F.round(completeness(answer, F.col("answer_requirements")), 2).alias("answer_completeness_pct"),
        F.round(hit_rate(evidence, F.col("evidence_requirements")), 2).alias("evidence_hit_rate_pct"),
        F.round("r.seconds", 3).alias("response_time_sec"),
    )


def summarize(detail: DataFrame) -> DataFrame:
    """V4: one row for each version: means of the rounded cases, and the exact median of times."""
    return detail.groupBy("version").agg(
        F.count(F.lit(1)).alias("n_test_cases"),
        F.count_if(tx.strip(F.col("answer")) != "").alias("n_answered"),
        F.round(F.avg("answer_completeness_pct"), 2).alias("mean_answer_completeness_pct"),
        F.round(F.avg("evidence_hit_rate_pct"), 2).alias("mean_evidence_hit_rate_pct"),
        F.round(F.avg("response_time_sec"), 3).alias("mean_response_time_sec"),
        F.round(F.expr("percentile(response_time_sec, 0.5)"), 3).alias("median_response_time_sec"),
    )


def difference(current: Column, baseline: Column) -> Column:
    """V5: null if either is."""
    return F.round(current - baseline, 3)


def relative_change(current: Column, baseline: Column) -> Column:
    """V5: in percent; null if either is null or the baseline is 0."""
    return F.round((current - baseline) / F.nullif(baseline, F.lit(0.0)) * 100.0, 2)


def safe_float(value: Column) -> Column:
    """the number that the text holds, or null."""
    return value.try_cast("double")


def shown(value: Column, digits: int = 2) -> Column:
    """the number with so many places, or N/A."""
    return F.when(value.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def arrow(delta: Column, lower_is_better: bool = False) -> Column:
    """up for better, down for worse, level for no change or null."""
    better = delta < 0 if lower_is_better else delta > 0
    return F.when(delta.isNull() | (F.abs(delta) < 1e-9), "→").when(better, "▲").otherwise("▼")


def _object(raw: Column) -> Column:
    return F.from_json(raw, "struct<final_answer: string, answer: string, evidence: array<struct<quote: string>>>")


def result_answer(raw: Column) -> Column:
    """V7: the answer of a result, whether a text or an object that holds it under one of two names."""
    found = lambda o: F.coalesce(F.nullif(o["final_answer"], F.lit("")), o["answer"], F.lit(""))
    return F.when(F.coalesce(raw, F.lit("")).rlike(r"^\s*\{"), tx.bound(_object(raw), found)).otherwise(F.coalesce(raw, F.lit("")))


def result_evidence(raw: Column) -> Column:
    """V7: the evidence of a result that is an object; an empty array otherwise."""
    return F.coalesce(F.when(raw.rlike(r"^\s*\{"), _object(raw)["evidence"]), F.array().cast("array<struct<quote: string>>"))


def compare(detail: DataFrame, baseline: str, current: str) -> DataFrame:
    """V6: for each case, both versions' quality (mean of both percentages), its change, and a verdict."""
    quality = (F.col("answer_completeness_pct") + F.col("evidence_hit_rate_pct")) / 2
    side = lambda v, name: detail.where(F.col("version") == v).select("id", quality.alias(name))
    rows = side(baseline, "baseline_quality").join(side(current, "current_quality"), "id", "full")
    delta = F.coalesce("current_quality", F.lit(0.0)) - F.coalesce("baseline_quality", F.lit(0.0))
    return rows.select("id", "baseline_quality", "current_quality", F.round(delta, 6).alias("delta"), F.when(delta > 0.01, "improved").when(delta < -0.01, "regressed").otherwise("same").alias("verdict"))


def compare_pivot(answers: DataFrame, configs: list[str]) -> DataFrame:
    """K6: one row for each question, one column for each configuration's answer."""
    return answers.groupBy("qid").pivot("config", configs).agg(F.first("answer"))


def page_lengths(chunks: DataFrame) -> DataFrame:
    """Summed lengths of text and section chunks of each page."""
    return chunks.where(F.col("kind").isin("text", "section")).groupBy("page").agg(F.sum(F.length("text")).alias("chars"))


def kind_counts(chunks: DataFrame) -> DataFrame:
    """V9."""
    return chunks.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
