"""Question plans without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import lexicon as lx
from gleanery.functions import text as tx


def question_parts(question: Column) -> Column:
    """The clauses of a question: cut at connectives and marks, also within words; four characters or more, distinct."""
    stripped = tx.strip(F.regexp_replace(tx.normalize_space(question), lx.IMPERATIVE_TAIL, ""))
    parts = F.filter(F.transform(F.split(stripped, lx.CONNECTIVES), tx.normalize_space), lambda p: F.length(p) >= 4)
    return tx.first_wins(parts, tx.normalize_for_tokenize)


def plan_questions(questions: DataFrame, question: str = "question", max_queries: int = 3, max_requirements: int = 6) -> DataFrame:
    """Adds answer_style, requirements (array of struct(id, requirement, type)), retrieval_queries and comprehensive."""
    q = tx.normalize_space(F.col(question))
    rows = questions.withColumn("_parts", F.slice(question_parts(F.col(question)), 1, max_requirements))
    required = F.transform("_parts", lambda p, i: F.struct(F.concat(F.lit("R"), (i + 1).cast("string")).alias("id"), p.alias("requirement"), tx.intent(p).alias("type")))
    others = F.filter("_parts", lambda p: (tx.normalize_for_tokenize(p) != tx.normalize_for_tokenize(q)) & (p != q))
    return rows.select(
        "*",
        tx.intent(q).alias("answer_style"),
        required.alias("requirements"),
        F.slice(F.array_distinct(F.concat(F.array(q), others)), 1, max_queries).alias("retrieval_queries"),
        (q.rlike(lx.COMPREHENSIVE) | (F.size("_parts") > 1)).alias("comprehensive"),
    ).drop("_parts")


def explode_queries(plans: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, query_no, query): the retrieval queries of each plan, numbered from 0."""
    return plans.select(key, F.posexplode("retrieval_queries").alias("query_no", "query"))


def normalize_plan(raw: Column, question: Column) -> Column:
    """Requirements of a model's plan as struct(id, requirement): null where the plan cannot be read.

    A requirement may come under several names; missing ids are numbered.
    """
    kind = "struct<requirements: array<struct<id: string, requirement: string, need: string, text: string, description: string>>>"
    found = F.from_json(tx.json_object(raw), kind)["requirements"]
    named = F.transform(found, lambda r, i: F.struct(F.coalesce(F.nullif(r["id"], F.lit("")), F.concat(F.lit("R"), (i + 1).cast("string"))).alias("id"), tx.normalize_space(F.coalesce(r["requirement"], r["need"], r["text"], r["description"], F.lit(""))).alias("requirement")))
    return F.filter(named, lambda r: r["requirement"] != "")
