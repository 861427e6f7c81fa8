"""Scalar functions on hand-computed values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators.chunking import windows
from gleanery.operators.units import similarity


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("none")])
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("조회 가능한 이용 경로를 모두 나열하세요.", "list"),
        ("어떤 앱을 설치해야 하나요?", "availability"),
        ("어떻게 변경하나요?", "procedure"),
        ("개인통관고유부호는 무엇인가요?", "definition"),
        ("안녕하세요", "general"),
    ],
)
def test_intent(spark, question, expected):
    assert one(spark, tx.intent(F.col("q")), q=question) == expected


@pytest.mark.parametrize(("question", "expected"), [("두 가지 이상 나열", 2), ("3개 이상", 3), ("두 가지", None)])
def test_requested_count(spark, question, expected):
    assert one(spark, tx.requested_count(F.col("q")), q=question) == expected


def test_tokens_and_overlap(spark):
    assert one(spark, tx.tokenize(F.col("q")), q="앱(App)과 PC/웹-이용 경우") == ["앱", "app", "pc", "웹", "이용"]
    assert one(spark, tx.query_overlap(F.col("q"), F.col("t")), q="모바일 앱 설치", t="모바일관세청 앱 실행") == 0.5
    assert one(spark, tx.query_overlap(F.col("q"), F.col("t")), q="", t="x") == 0.0


def test_lists(spark):
    assert one(spark, tx.list_signal(F.col("t")), t="A, B, C: (x)") == pytest.approx(1.2)
    assert one(spark, tx.list_items(F.col("t")), t="인증방법: 휴대폰인증, 간편인증, 휴대폰인증") == ["휴대폰인증", "간편인증"]


def test_critical_terms(spark):
    assert one(spark, tx.critical_terms(F.col("q")), q="24시간 즉시 발급 가능") == ["24시간", "즉시", "가능"]


def test_polarity_and_estimate(spark):
    assert one(spark, tx.polarity(F.col("q"), F.col("t")), q="휴대전화가 없을 때", t="조회 가능합니다") == -0.35
    assert one(spark, tx.token_estimate(F.col("t")), t="abcd가나") == 34


def test_page_spec(spark):
    assert one(spark, tx.page_spec(F.col("t")), t="섹션 3, p.4-8, 분할 0") == [0, 3, 4, 5, 6, 7, 8]
    assert one(spark, tx.page_spec(F.col("t")), t="p.4-8") == [4, 5, 6, 7, 8]


def test_alias_hit(spark):
    aliases = F.array(F.lit("신청한즉시"), F.lit("24시간"))
    assert one(spark, tx.alias_hit(F.col("t"), aliases), t="신청한 즉시 발급됩니다") is True
    assert one(spark, tx.alias_hit(F.col("t"), aliases), t="나중에") is False


def test_json_object(spark):
    assert one(spark, tx.json_object(F.col("t")), t='so: {"a": 1} ok') == '{"a": 1}'
    assert one(spark, tx.json_object(F.col("t")), t="none") is None


def test_noise(spark):
    assert one(spark, tx.noise_ratio(F.col("t")), t="") == 1.0
    assert one(spark, tx.noise_ratio(F.col("t")), t="ab§§") == 0.5


def test_similarity():
    assert similarity("abc", "xabcx") == 1.0
    assert similarity("", "a") == 0.0
    assert similarity("tide", "diet") == 0.25 or similarity("tide", "diet") == 0.5


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n?다", max_size=400))
def test_windows_cover_the_text(text):
    pieces = windows(text, 60, 20)
    assert all(len(p) <= 60 for p in pieces)
    assert "".join(pieces).count("b") >= text.count("b")
    if text:
        assert text.startswith(pieces[0]) and text.endswith(pieces[-1])
