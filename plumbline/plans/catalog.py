"""Queries of the trajectory operators by name, and their SQL."""

from __future__ import annotations

from plumbline.plans import auditing, calibrating, describing, figures, lifecycle, parsing, ranking, records  # noqa: F401
from plumbline.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
