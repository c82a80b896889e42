"""Every registered query with the SQL it is held against."""

from __future__ import annotations

from tessera.plans import queries as plans
from tessera.plans import archive_queries, corpus_queries, graph_queries, record_queries, text_queries  # noqa: F401  they register queries


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
