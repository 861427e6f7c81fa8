"""Evidence for an answer: united by priority, mapped to requirements, cut to a budget, composed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import text as tx
from gleanery.operators.units import dedupe_units

#: Order of sources: sections of a comprehensive answer, the seed's quotes, ranked units, other sections, supporting context.
PRIORITY = {"coverage_section": 0, "seed": 1, "unit": 2, "section": 3, "context": 4}


def unite_evidence(items: DataFrame, most: int = 12) -> DataFrame:
    """Of items (qid, source_priority, source_pos, source_chunk_id, text, ...), the distinct ones in order of priority.

    Equal chunk and first 160 canonical characters count as equal. Adds evidence_no, from 1.
    """
    rows = items.where(F.col("text") != "").withColumn("_key", F.substring(tx.canonical(F.col("text")), 1, 160))
    first = Window.partitionBy("qid", "source_chunk_id", "_key").orderBy("source_priority", "source_pos")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_key")
    order = Window.partitionBy("qid").orderBy("source_priority", "source_pos", "source_chunk_id")
    return rows.withColumn("evidence_no", F.row_number().over(order)).where(F.col("evidence_no") <= most)


def section_evidence(sections: DataFrame, most: int = 2, share: float = 0.72) -> DataFrame:
    """The sections (qid, chunk_index, relevance, anchor_score) of a comprehensive question.

    The most relevant one, and further ones whose anchor is nearly as close as the closest.
    """
    own = Window.partitionBy("qid")
    rows = sections.withColumn("pos", F.row_number().over(own.orderBy(F.round("relevance", 9).desc(), "chunk_index"))).withColumn("top", F.max("anchor_score").over(own))
    rows = rows.where((F.col("pos") == 1) | (F.col("top") <= 0) | (F.col("anchor_score") >= F.col("top") * share))
    return rows.withColumn("source_pos", F.row_number().over(own.orderBy("pos"))).where(F.col("source_pos") <= most).drop("pos", "top")


def context_relevance(question: Column, requirements: list[Column], text: Column, rerank: Column, rrf: Column) -> Column:
    """Overlap with the question and, for less, with each requirement, and a little of both scores."""
    score = tx.query_overlap(question, text)
    for wanted in requirements:
        score = score + 0.7 * tx.query_overlap(wanted, text)
    return score + 0.05 * F.coalesce(rerank, F.lit(0.0)) + 0.3 * F.coalesce(rrf, F.lit(0.0))


def requirement_scores(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, requirement_no, evidence_no, score) of requirements (qid, question, requirement_no, requirement) and their question's evidence."""
    pairs = requirements.join(evidence, "qid")  # a question has few requirements and at most its cap of evidence
    text = tx.normalize_space(F.col("text"))
    score = 1.15 * tx.query_overlap(F.col("requirement"), text) + 0.45 * tx.query_overlap(F.col("question"), text) - 0.06 * F.col("source_priority") + tx.polarity(F.col("question"), text) - F.when(F.col("source_kind") == "ocr", 0.25).otherwise(0.0)
    return pairs.select("qid", "requirement_no", "evidence_no", "source_chunk_id", score.alias("score"))


def map_requirements(scores: DataFrame, each: int = 3, per_chunk: int = 2) -> DataFrame:
    """(qid, requirement_no, evidence_no, pick): the best evidence of each requirement, by turns of requirements.

    A chunk gives at most ``per_chunk`` new pieces to a question, over all requirements, so a
    question's requirements are walked together; their number is bounded by the plan.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        used: dict = {}
        out = []
        for no, rows in group.sort_values(["requirement_no"]).groupby("requirement_no"):
            n = 0
            for row in rows.assign(s=-rows["score"].round(9)).sort_values(["s", "evidence_no"]).itertuples():
                if used.get(row.source_chunk_id, 0) >= per_chunk and row.evidence_no not in taken:
                    continue
                taken.add(row.evidence_no)
                used[row.source_chunk_id] = used.get(row.source_chunk_id, 0) + 1
                n += 1
                out.append((row.qid, no, row.evidence_no, n))
                if n >= each:
                    break
        return pd.DataFrame(out, columns=["qid", "requirement_no", "evidence_no", "pick"])

    return scores.groupBy("qid").applyInPandas(pick, "qid long, requirement_no long, evidence_no long, pick long")


def fit_budget(evidence: DataFrame, budget: int, least: int = 2) -> DataFrame:
    """The first pieces (qid, evidence_no, text) that fit the token budget, at least ``least``.

    If even those do not fit, each is cut, once, to its share of the budget, but not under 240 characters.
    """
    own = Window.partitionBy("qid")
    running = F.sum(tx.token_estimate(F.col("text"))).over(own.orderBy("evidence_no").rowsBetween(Window.unboundedPreceding, 0))
    kept = evidence.withColumn("tokens_to_here", running).where((F.col("tokens_to_here") <= budget) | (F.col("evidence_no") <= least))
    ratio = F.least(F.lit(0.85), F.greatest(F.lit(0.25), F.lit(float(budget)) / F.max("tokens_to_here").over(own)))
    size = F.greatest(F.lit(240), F.floor(F.length("text") * ratio)).cast("int")
    long = (F.max("tokens_to_here").over(own) > budget) & (F.length("text") > size)
    return kept.withColumn("text", F.when(long, F.concat(F.substr("text", F.lit(1), size), F.lit("…"))).otherwise(F.col("text")))


def seed_answers(units: DataFrame, most: int = 6) -> DataFrame:
    """E5: (qid, final_answer, quotes): the first two distinct of a question's best units joined."""
    kept = dedupe_units(units, most=most)
    lines = F.array_sort(F.collect_list(F.struct("unit_no", tx.clean_unit(F.col("text")).alias("quote"))))
    out = kept.groupBy("qid").agg(F.transform(lines, lambda s: s["quote"]).alias("quotes"))
    return out.select("qid", tx.normalize_space(F.array_join(F.slice("quotes", 1, 2), " ")).alias("final_answer"), "quotes")
