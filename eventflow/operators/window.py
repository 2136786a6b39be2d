"""Tumbling window aggregates, by key or over all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.functions.windows import Tumbling
from eventflow.stream import Stream

#: What a window's rows carry beside the aggregates.
START, END, TIME = "window_start", "window_end", "event_ts"


def aggregate(
    stream: Stream, name: str, spec: Tumbling, aggregates: Sequence[Column] | None = None, keys: Sequence[str] | None = None, global_key: bool = False,
    process: Callable[[DataFrame], DataFrame] | None = None, pass_through: bool = False,
) -> Stream:
    """One row per key and window: keys, window bounds, aggregates, and the event time of the result (end - 1 ms).

    ``keys`` or ``global_key`` is needed, as are aggregates.  ``process`` turns a window's row into none or many;
    ``pass_through`` leaves the aggregates (and the event time) alone.  On unbounded input results appear once the watermark passes
    the window's end (append), or with every batch (update).
    """
    if spec is None:
        raise ValueError("a window assigner is needed")
    if not aggregates:
        raise ValueError("an aggregator is needed")
    if not keys and not global_key:
        raise ValueError("a key selector is needed (or global_key)")
    if keys and global_key:
        raise ValueError("either keys or a global key")
    if process and pass_through:
        raise ValueError("either a process function or pass-through")
    by = list(keys or [])

    def run(df: DataFrame) -> DataFrame:
        if df.isStreaming and not spec.processing and stream.event_time is None:
            raise ValueError("event-time windows need event time: assign timestamps first")
        window = spec.column(stream.event_time)
        grouped = df.groupBy(window.alias("window"), *by).agg(*aggregates)
        made = [c for c in grouped.columns if c not in ("window", *by)]
        time = (F.col("window.end") - F.expr("INTERVAL 0.001 SECOND")).alias(TIME)
        if pass_through:
            return grouped.select(*made, time)
        out = grouped.select(*by, F.col("window.start").alias(START), F.col("window.end").alias(END), *made, time)
        return process(out) if process else out

    return stream.apply(name, run, TIME)
