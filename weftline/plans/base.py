"""How a query is registered: a function and, where SQL can express it, the SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import with_tables

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def add(query: Query) -> Query:
            key = name or query.__name__
            self.queries[key] = query
            if sql is not None:
                self.sql[key] = with_tables(sql)
            return query

        return add
