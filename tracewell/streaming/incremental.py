"""Incremental versions on Structured Streaming, beyond the batch operators: windowed counts and micro-batch ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def account_windows(events: DataFrame, length: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Transfers and volume of every account in sliding windows; rows later than ``late`` are left out."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", length, slide), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("volume"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of an account: runs of events without a longer gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def ingest(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]):
    """Run a batch function over every micro-batch once, until what is there is processed."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
