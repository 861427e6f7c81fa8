"""Defaults of retrieval, units and evidence."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    dense_k: int = 60
    bm25_k: int = 60
    rrf_k: int = 60
    candidate_k: int = 40
    rerank_pool_k: int = 40
    top_k: int = 14
    expand_window: int = 2
    max_context_chunks: int = 24
    num_retrieval_queries: int = 3
    max_chars_per_window: int = 900
    window_overlap: int = 120
    max_units_per_chunk: int = 16
    max_chars_per_answer_unit: int = 1500
    unit_cross_top_n: int = 28
    max_answer_units: int = 18
    max_question_requirements: int = 6
    context_token_budget: int = 6200
    max_composer_evidence: int = 12
    max_composer_sections: int = 3
    max_chars_per_composer_evidence: int = 1400
    reranker: str = "lexical"

    def __post_init__(self):
        if self.reranker not in ("lexical", "off"):
            raise ValueError(f"unknown reranker: {self.reranker}")


#: Parameters of the term weights, and the share of the mean weight that stands for a negative one.
BM25_K1, BM25_B, BM25_FLOOR = 1.5, 0.75, 0.25
