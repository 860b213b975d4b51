"""Every operator bound to the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Queries by name; ``add`` registers a function of (tables) with its SQL."""

    def __init__(self) -> None:
        self.functions: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None) -> Callable:
        def register(function: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return function(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            run.__name__, run.__doc__ = function.__name__, function.__doc__
            self.functions[function.__name__] = run
            if sql:
                self.sql[function.__name__] = sql
            return function

        return register


registry = Registry()


def load() -> Registry:
    from . import decision_queries, graph_queries, group_queries, join_queries, plan_queries, text_queries  # noqa: F401

    return registry
