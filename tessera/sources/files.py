"""Files in and out: delimited text (COPY), tables with their schema (dump and restore), materialized views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def copy_to(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, null: str = "\\N", quote: str = '"', escape: str = '"') -> None:
    df.write.mode("overwrite").csv(path, sep=delimiter, header=header, nullValue=null, emptyValue="", quote=quote, escape=escape)


def copy_from(spark: SparkSession, path: str, schema: StructType | str, delimiter: str = ",", header: bool = True, null: str = "\\N", quote: str = '"', escape: str = '"', on_error: str = "stop") -> DataFrame:
    """on_error: stop raises at the first bad line, continue leaves bad lines out."""
    mode = {"stop": "FAILFAST", "continue": "DROPMALFORMED"}[on_error]
    return spark.read.csv(path, schema=schema, sep=delimiter, header=header, nullValue=null, emptyValue="", quote=quote, escape=escape, mode=mode, multiLine=False)


def dump(df: DataFrame, path: str, codec: str = "zstd", partition_by: list[str] | None = None) -> None:
    """A table as Parquet, with the codec none, lz4 or zstd, partitioned by the values of columns."""
    df.write.mode("overwrite").option("compression", codec).partitionBy(*(partition_by or [])).parquet(path)


def restore(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


class MaterializedView:
    """A query's rows kept as Parquet until they are refreshed; a refresh writes beside the old rows and then switches."""

    def __init__(self, spark: SparkSession, path: str, query):
        self.spark, self.path, self.query, self.version = spark, path, query, 0
        self.refresh()

    def refresh(self) -> None:
        self.version += 1
        self.query().write.mode("overwrite").parquet(f"{self.path}/v{self.version}")

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version}")
