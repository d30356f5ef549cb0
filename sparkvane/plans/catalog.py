"""All registered reference queries with their oracle SQL."""

from __future__ import annotations

from . import q_basic, q_extra, q_more, q_series  # noqa: F401
from .registry import QUERIES, SQL

FLAGSHIP = "category_drift_findings"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
