"""A plan module's queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Plans:
    """Collects (name, Spark query, SQL)."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, so that engines with other summation orders agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
