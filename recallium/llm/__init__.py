"""Operators for preparing training corpora. Nothing outside this subpackage imports it."""

from recallium.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
