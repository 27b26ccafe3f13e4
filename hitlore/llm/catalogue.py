"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from hitlore.llm.queries import QUERIES
from hitlore.llm.sql import SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
