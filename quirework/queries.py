"""Registry of the engine's queries: name -> callable, and their DuckDB SQL."""

from __future__ import annotations

from quirework.plans import evaluate_queries, page_queries, result_queries, source_queries, text_queries

PARTS = (text_queries, page_queries, result_queries, evaluate_queries, source_queries)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
