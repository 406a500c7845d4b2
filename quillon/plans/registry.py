"""Registered queries and their SQL."""

from __future__ import annotations

from quillon.plans.queries import QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
