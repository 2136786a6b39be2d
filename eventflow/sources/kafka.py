"""Kafka, where Spark's connector is on the class path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_stream(spark: SparkSession, servers: Sequence[str], topics: Sequence[str], group: str | None = None, value: Column | None = None, starting: str = "earliest", max_per_batch: int | None = None, **options: str) -> DataFrame:
    """Messages as rows; offsets are part of each batch's checkpoint.  ``value`` formats a message (default: its value as text)."""
    if not servers or not topics:
        raise ValueError("servers and topics are needed")
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", ",".join(servers)).option("subscribe", ",".join(topics)).option("startingOffsets", starting)
    if group:
        reader = reader.option("kafka.group.id", group)
    if max_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", max_per_batch)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select("topic", "partition", "offset", F.col("timestamp").alias("event_ts"), (value if value is not None else F.col("value").cast("string")).alias("value"))
