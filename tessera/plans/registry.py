"""Queries with the SQL that their rows are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Area:
    """The queries of one subject; `query` registers a function under the subject's name and its own."""

    def __init__(self, name: str):
        self.name = name
        self.QUERIES: dict[str, Query] = {}
        self.ORACLES: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            key = f"{self.name}_{f.__name__}"
            self.QUERIES[key] = f
            if sql:
                self.ORACLES[key] = sql
            return f

        return register
