"""Queries over the supplied tables, one for each operator and function, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import relational, scalars, storage
from tessera.session import reachable

Query = Callable[[SparkSession, str], DataFrame]


def _ready(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _ready(q) for module in (relational, scalars, storage) for name, q in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return relational.oracle_sql() | scalars.oracle_sql() | storage.oracle_sql()
