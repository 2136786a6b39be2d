"""Event time: timestamp assignment and bounded-out-of-orderness watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, TimestampNTZType

from eventflow.stream import Stream


def as_event_time(df: DataFrame, timestamp: Column | str) -> Column:
    """A TIMESTAMP from epoch milliseconds, a timestamp, or one without time zone (read as UTC)."""
    col = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    kind = df.select(col.alias("t")).schema["t"].dataType
    if isinstance(kind, LongType):
        return F.timestamp_millis(col)
    if isinstance(kind, TimestampNTZType):
        return col.cast("timestamp")
    return col


def epoch_ms(timestamp: Column) -> Column:
    return F.unix_millis(timestamp.cast("timestamp"))


def nearest_ms(timestamp: Column | str) -> Column:
    """A timestamp moved to its nearest millisecond, halves away from the epoch, as SQL's ``epoch_ms`` takes it (``epoch_ms`` here cuts off)."""
    us = F.unix_micros((F.col(timestamp) if isinstance(timestamp, str) else timestamp).cast("timestamp"))
    return F.timestamp_millis(F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000)))


def assign_timestamps(stream: Stream, name: str, timestamp: Column | str, column: str = "event_ts", out_of_orderness_ms: int | None = 0, lateness_ms: int = 0) -> Stream:
    """Rows with an event time, and on unbounded input a watermark ``out_of_orderness_ms`` (+ lateness) behind the latest.

    ``None`` assigns times without a watermark: windows over such an unbounded stream can't close.
    On bounded input no watermark is needed: everything is known, as after a last watermark at the end of time.
    """
    if timestamp is None:
        raise ValueError("a timestamp assigner is needed")
    for what, ms in (("out-of-orderness", out_of_orderness_ms), ("lateness", lateness_ms)):
        if ms is not None and ms < 0:
            raise ValueError(f"{what} can't be negative")

    def assign(df: DataFrame) -> DataFrame:
        out = df.withColumn(column, as_event_time(df, timestamp))
        if out_of_orderness_ms is None or not out.isStreaming:
            return out
        return out.withWatermark(column, f"{out_of_orderness_ms + lateness_ms} milliseconds")

    return stream.apply(name, assign, column)
