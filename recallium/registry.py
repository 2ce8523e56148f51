"""All queries of the engine, and their SQL."""

from __future__ import annotations

from recallium import catalog
from recallium.plans import admission_queries, compaction_queries, conversation_queries, dedup_queries, lifecycle_queries, metadata_queries, retrieval_queries, rule_queries, search_queries, statistics_queries, store_queries, text_queries, version_queries, write_queries  # noqa: F401  they register themselves


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
