"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from lexmill.plans import corpus_queries, general_problems, search_queries

QUERIES = {**general_problems.QUERIES, **corpus_queries.QUERIES, **search_queries.QUERIES}
SQL: dict[str, str] = {**general_problems.SQL, **corpus_queries.SQL, **search_queries.SQL}
FLAGSHIP = "hybrid_search"
