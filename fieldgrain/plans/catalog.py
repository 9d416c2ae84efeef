"""Registry of named queries: a Spark builder, the operators it covers, and SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, build, sql, covers)
        return build

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded output column, so that summation order does not show."""
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, digits)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every floating column of a result."""
    return df.select(
        *[
            r(c, special.get(c, digits)).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )
