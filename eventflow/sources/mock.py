"""Rows made up at a steady pace, for tests and demonstrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mock_stream(spark: SparkSession, value: Column | None = None, number: int = 1000, interval_ms: int = 1000, partitions: int | None = None) -> DataFrame:
    """``number`` rows per micro-batch, times ``interval_ms`` apart; ``value`` may use the row's ``n``."""
    if number < 1 or interval_ms < 1:
        raise ValueError("number and interval are 1 or more")
    reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", number).option("advanceMillisPerBatch", interval_ms)
    if partitions:
        reader = reader.option("numPartitions", partitions)
    rows = reader.load().select(F.col("timestamp").alias("created"), F.col("value").alias("n"))
    return rows.select("created", "n", (value if value is not None else F.lit("mock")).alias("value"))


def mock_rows(spark: SparkSession, value: Column | None = None, number: int = 1000, rounds: int = 1) -> DataFrame:
    """The bounded counterpart."""
    return spark.range(number * rounds).select(F.col("id").alias("n"), (value if value is not None else F.lit("mock")).alias("value"))
