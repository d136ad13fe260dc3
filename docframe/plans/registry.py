"""A register of queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Register:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name, with the SQL that gives the same rows."""

        def add(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = sql
            return query

        return add


_TABLE = re.compile(r"\bFROM (documents|pages|benchmark|labels|conversations|embeddings|events|part|customer|supplier|orders|lineitem|nation|region)\b")


def rows(spark: SparkSession, source: str, sf_dir: str) -> DataFrame:
    """A table expression in SQL that both engines read alike, over the Parquet tables of a folder."""
    return spark.sql("SELECT * FROM " + _TABLE.sub(lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", source))


def over(values: str, table: str = "events", key: str = "event_id") -> str:
    """A table expression with a row for each row of a table: its key as the first column, and the other columns of one of the
    cases (VALUES ...) t(id, ...), which are numbered from 1 and taken in turn."""
    cases, alias, columns = re.fullmatch(r"\((VALUES .*)\) (\w+)\(([^()]*)\)", values, re.DOTALL).groups()
    first, rest = columns.split(", ", 1)
    depth = n = 0
    quoted = False
    for c in cases:
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            n += c == "(" and depth == 1
    return f"(SELECT _key AS {first}, {rest} FROM (SELECT {key} AS _key, {key} % {n} + 1 AS _case FROM {table}) k JOIN ({cases}) v(_case, {rest}) USING (_case)) {alias}"
