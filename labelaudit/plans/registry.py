"""Named queries, each with the SQL that a second engine must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelaudit.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *parts: str) -> Callable[[Query], Query]:
    """Register a query. ``parts`` are common table expressions and, last, the SELECT."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if parts:
            *ctes, body = parts
            ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + body
        return fn

    return register


def r6(column: Column | str, name: str | None = None) -> Column:
    """Six digits: sums are added up in another order by each engine."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)
