"""Where plans register their queries and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **types: str) -> Callable[[Query], Query]:
    """Register fn as ``name``; sql is the DuckDB statement with the same rows, None where SQL has none. types: columns that
    DuckDB would give another type than Spark (decimal literals, sums), with the type they get."""
    if types:
        sql = "SELECT * REPLACE (" + ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in types.items()) + f") FROM ({sql})"

    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
