"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries by name; a query without SQL is checked against brute force in the tests."""

    def __init__(self) -> None:
        self.runs: dict[str, Run] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        def register(run: Run) -> Run:
            if name in self.runs:
                raise ValueError(f"two queries are named {name}")
            self.runs[name] = run
            if sql is not None:
                self.sql[name] = sql
            return run

        return register
