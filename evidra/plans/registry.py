"""Registration of queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL for the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def sql_fold(x: str) -> str:
    return f"replace(strip_accents(lower({x})), 'đ', 'd')"


def sql_words(x: str) -> str:
    return f"regexp_extract_all({sql_fold(x)}, '[\\p{{L}}\\p{{N}}]+')"
