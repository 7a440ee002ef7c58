"""All queries of the analytics packages, and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


from .queries import daily, detector, scans, sets, texts, votes  # noqa: E402, F401 - each registers its queries
from .streaming import queries as _streaming  # noqa: E402, F401
