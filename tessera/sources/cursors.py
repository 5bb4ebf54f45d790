"""Cursors, prepared statements and sequences on the driver's side."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import shared_folder


class Cursor:
    """Rows of a query in chunks; one partition at a time comes to the driver."""

    def __init__(self, df: DataFrame):
        self._rows: Iterator[Row] = df.toLocalIterator(prefetchPartitions=True)

    def fetch(self, n: int) -> list[Row]:
        return list(islice(self._rows, n))

    def move(self, n: int) -> int:
        return len(self.fetch(n))


class Prepared:
    """A statement with named parameters (:name), planned when it is run."""

    def __init__(self, spark: SparkSession, text: str):
        self.spark, self.text = spark, text

    def execute(self, **values) -> DataFrame:
        return self.spark.sql(self.text, args=values)


class Sequence:
    """Numbers that are handed out once. number(df) gives each row the next, in the given order, without a global sort of hot data: ranges of the order are counted first."""

    def __init__(self, start: int = 1):
        self.value = start - 1

    def next(self) -> int:
        self.value += 1
        return self.value

    def number(self, df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
        """Ranges of the order are sorted and counted in one job; the second numbers them. The ranges are written where spark.checkpoint.dir says, so that both see the same."""
        shared_folder(df.sparkSession)
        ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
        counts = sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect())
        before, total = {}, self.value
        for p, n in counts:
            before[p], total = total, total + n
        self.value = total
        if not before:
            return df.withColumn(name, F.lit(None).cast("long"))
        offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_p")]
        return ranged.withColumn(name, (F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + offset).cast("long")).drop("_p")
