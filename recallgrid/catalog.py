"""All registered queries of the library with the SQL to check them with."""

from __future__ import annotations

from recallgrid.plans import aggregates, cascade, extractions, graphs, lifecycle, reads, recall, rules, search, streams, texts, writes  # noqa: F401
from recallgrid.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
