"""Sort orders with explicit places for NULL: last when ascending, first when descending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascending(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).asc_nulls_last()


def descending(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).desc_nulls_first()
