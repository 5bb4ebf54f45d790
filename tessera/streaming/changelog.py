"""Change logs as streams: files of changes with op, seq and the row; and windowed counts of events as an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators.changes import latest


def changes(spark: SparkSession, path: str, schema: StructType, per_poll: int = 1) -> DataFrame:
    """The change files of a folder, at most per_poll of them a micro-batch; a query's checkpoint is its slot."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_poll).parquet(path)


def follow(stream: DataFrame, base: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], keys: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps of each key the latest change (op, seq and the row; a deleted key stays as its D) in the base table, and saves that under the batch's number. Files may come in any order, and a batch that is run again saves the same."""
    return stream.writeStream.foreachBatch(lambda batch, number: save(latest(base().unionByName(batch), keys), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decoded(log: DataFrame, name: str) -> DataFrame:
    """Changes as lines of text: table name: OPERATION: column:value ..."""
    columns = [c for c in log.columns if c not in ("op", "seq")]
    verb = F.expr("CASE op WHEN 'I' THEN 'INSERT' WHEN 'U' THEN 'UPDATE' ELSE 'DELETE' END")
    return log.select("seq", F.concat(F.lit(f"table {name}: "), verb, F.lit(": "), F.concat_ws(" ", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns])).alias("line"))


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: events by type and tumbling window, with a watermark for late ones."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
