"""Structured Streaming: new files of a folder, each row once, matched as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, files: str, schema: str, at: str, key: str, late: str = "1 hour") -> DataFrame:
    """A stream of the Parquet files (a folder or glob); a key that comes again within the watermark is dropped."""
    rows = spark.readStream.schema(schema).parquet(files)
    rows = rows.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def drain(rows: DataFrame, out: str, progress: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Append all that has come to Parquet under out, and stop; a later call goes on where this one ended.

    The sink's log and the checkpoint in progress give each row exactly once, also when executors are lost.
    """
    query = then(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
