"""Named queries over the graph views, each with the SQL that an independent engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans.views import Graph, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function from Graph to DataFrame; sql may use the graph views by name."""

    def add(fn: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Graph(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE_SQL[key] = with_views(sql)
        return fn

    return add
