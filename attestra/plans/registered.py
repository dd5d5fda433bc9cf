"""Where modules of queries put them: by name, each name once, with the DuckDB twin if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registered:
    def __init__(self, *others: Registered) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle_sql: dict[str, str] = {}
        for other in others:
            for name, query in other.queries.items():
                self.register(name, other.oracle_sql.get(name))(query)

    def register(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        if name in self.queries:
            raise ValueError(f"{name} is registered already")

        def keep(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.oracle_sql[name] = sql
            return query

        return keep
