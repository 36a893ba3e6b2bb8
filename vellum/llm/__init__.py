"""Operators for preparing large text collections. Nothing outside this subpackage imports it."""

from __future__ import annotations


def queries() -> dict:
    """The pN_ queries of this subpackage, by name."""
    return tasks.QUERIES


def oracle_sql() -> dict:
    """SQL for those queries that SQL can express over whole tables."""
    return sql.ORACLE


# Whatever is missing for one of the queries shows as the subpackage is imported.
from vellum.llm import sql, tasks  # noqa: E402
