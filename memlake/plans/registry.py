"""Queries by name, each with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Queries:
    def __init__(self) -> None:
        self.run: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function under its own name."""

        def keep(f: Query) -> Query:
            self.run[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep
