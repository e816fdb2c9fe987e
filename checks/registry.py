"""Registry of checked queries: a Spark callable and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Floating columns rounded, so that summation order cannot show."""
    return df.select(*[
        F.round(F.col(f.name).cast("double"), places).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def r(expression: str, alias: str, places: int = 4) -> str:
    """The same rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"round(cast({expression} as double), {places}) + 0.0 AS {alias}"
