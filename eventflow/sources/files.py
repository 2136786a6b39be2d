"""Bounded and unbounded file sources (Parquet; other formats that Spark reads by name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """All rows there are: a bounded stream."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_stream(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet", files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """Files of a folder as they come; ``files_per_batch`` bounds the work in flight."""
    if schema is None:
        schema = spark.read.format(fmt).load(path).schema  # of the files there are now
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def replay(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table replayed as a stream."""
    return read_stream(spark, sf_dir, table(spark, sf_dir, name).schema, files_per_batch=files_per_batch, pattern=f"{name}.parquet")
