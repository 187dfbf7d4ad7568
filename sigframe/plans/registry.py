"""Registry of named queries: each has a Spark implementation over the given
tables and, where SQL can express it, an independent DuckDB oracle.

Query callables take ``(spark, sf_dir)`` and return a DataFrame whose
floating columns are rounded to ``oracle.DIGITS`` (the oracle rounds too).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sigframe.functions.columns import round_doubles
from sigframe.plans.oracle import DIGITS
from sigframe.session import ship_package


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return round_doubles(self.build(spark, sf_dir), DIGITS)


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(ops.split()))
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    # import side effects register the query families
    from sigframe.plans import q_catalogue, q_extra, q_models, q_more, q_regions, q_selection, q_series  # noqa: F401

    return REGISTRY
