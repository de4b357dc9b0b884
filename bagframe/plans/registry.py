"""Registered queries with their column types and, where SQL can say it, the same question for DuckDB.

A query is registered with a column signature such as ``"split:s n:l auc:d"``. Both sides are reduced to exactly these
columns and types: s text, l BIGINT, d DOUBLE rounded, b BOOLEAN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagframe.plans.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _spark(name: str, kind: str, digits: int) -> Column:
    c = F.col(f"`{name}`")
    if kind == "s":
        e = c.cast("string")
    elif kind == "l":
        e = c.cast("long")
    elif kind == "b":
        e = c.cast("boolean")
    else:
        e = F.round(c.cast("double"), digits) + F.lit(0.0)
    return e.alias(name)


def _duckdb(name: str, kind: str, digits: int) -> str:
    c = f'"{name}"'
    return {"s": f"cast({c} as varchar)", "l": f"cast({c} as bigint)", "b": f"cast({c} as boolean)",
            "d": f"round(cast({c} as double), {digits}) + 0.0e0"}[kind] + f" as {c}"


def query(name: str, cols: str, sql: str | None = None, views: tuple[str, ...] | str = (), digits: int = 6, **subqueries: str):
    """Register a function (spark, sf_dir) -> DataFrame."""
    pairs = [tuple(c.rsplit(":", 1)) for c in cols.split()]
    views = (views,) if isinstance(views, str) else views

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(spark, sf).select(*[_spark(n, k, digits) for n, k in pairs])

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            chosen = ", ".join(_duckdb(n, k, digits) for n, k in pairs)
            ORACLE[name] = with_views(f"select {chosen} from ({sql.strip()}) as answer", *views, **subqueries)
        return fn

    return register
