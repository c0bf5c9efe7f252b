"""All registered queries of the library."""

from __future__ import annotations

from gleaner.plans import answer_queries, corpus_queries, review_queries, search_queries, source_queries, step_queries
from gleaner.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answer_queries", "corpus_queries", "review_queries", "search_queries", "source_queries", "step_queries"]
