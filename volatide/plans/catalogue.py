"""Every registered query of the analytics part, with its DuckDB counterpart."""

from __future__ import annotations

from volatide.plans import corpus_queries, market_queries, model_queries, news_queries

PARTS = (market_queries, news_queries, corpus_queries, model_queries)
QUERIES: dict = {name: query for part in PARTS for name, query in part.REGISTRY.queries.items()}
ORACLES: dict = {name: sql for part in PARTS for name, sql in part.REGISTRY.oracles.items()}
