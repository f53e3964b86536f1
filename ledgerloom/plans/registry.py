"""Registered queries of the ingestion engine and their SQL."""

from __future__ import annotations

from ledgerloom.plans import file_queries  # noqa: F401  (registers its queries)
from ledgerloom.plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
