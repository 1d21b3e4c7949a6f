"""All registered queries of the core and their SQL."""

from __future__ import annotations

from . import eval_queries, retrieval_queries, source_queries, text_queries
from .pipeline import flagship  # noqa: F401

MODULES = (text_queries, retrieval_queries, eval_queries, source_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
