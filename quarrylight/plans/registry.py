"""A registry of named queries, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.core.storage import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of one data folder, read when asked for."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.base, name)


class Plans:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Registers a function of ``Tables`` under ``name``."""

        def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[name] = lambda spark, base: build(Tables(spark, base))
            if sql is not None:
                self.sql[name] = sql
            return build

        return register


#: Queries in words, as users type them, for the operators on queries.
QUERY_TEXTS = [
    (1, "posting lists after restart"), (2, "parse_config token"), (3, "how does the outbox worker retry"), (4, "graph::walkNode"), (5, '"sealed generations"'),
    (6, "createEmptyClip2 for the chunk"), (7, "delete stale chunks"), (8, "get symbol cards"), (9, "src/storage/item.md"), (10, "the and of"), (11, "update frontier"), (12, "a->b.c d e f"),
]
QUERY_VALUES = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUERY_TEXTS) + ") AS q(query_id, query)"


def query_table(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(QUERY_TEXTS, "query_id int, query string")
