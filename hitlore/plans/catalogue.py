"""All queries outside the llm subpackage, and their SQL twins."""

from __future__ import annotations

from hitlore.plans import drift_queries, drift_sql, log_queries, log_sql, requests_queries, requests_sql

FLAGSHIP = "p5_found"


def queries() -> dict:
    return {**drift_queries.QUERIES, **requests_queries.QUERIES, **log_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**drift_sql.SQL, **requests_sql.SQL, **log_sql.SQL}
