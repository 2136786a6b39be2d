"""Sinks: callbacks per batch and per watermark, memory, Parquet, custom writers."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from eventflow.environment import Environment
from eventflow.stream import Stream


class Sink:
    """``batch`` gets each micro-batch with its number (the same number after a restart, so writes can be made once).

    Of a checkpoint (a batch with its offsets and state) a sink hears that it comes, and that it is complete or cancelled.  Watermarks rise; the last
    one, and ``close``, come once the query has ended.  Any object with ``batch`` will do: what else it lacks is not called.
    """

    def open(self) -> None:
        pass

    def batch(self, df: DataFrame, number: int) -> None:
        raise NotImplementedError("a sink takes batches: define batch")

    def watermark(self, ms: int) -> None:
        pass

    def checkpoint_comes(self, number: int) -> None:
        pass

    def checkpoint_complete(self, number: int) -> None:
        pass

    def checkpoint_cancelled(self, number: int) -> None:
        pass

    def close(self) -> None:
        pass


def _tell(sink: object, what: str, *args: int) -> None:
    if (method := getattr(sink, what, None)) is not None:
        method(*args)


def watermark_ms(query: StreamingQuery) -> int | None:
    """The watermark that the last batch ended with."""
    progress = query.lastProgress
    stamp = ((progress["eventTime"] if progress else None) or {}).get("watermark")
    if not stamp:
        return None
    return int(datetime.datetime.fromisoformat(stamp.replace("Z", "+00:00")).timestamp() * 1000)


class _Delivery:
    """One query's batches into a sink."""

    def __init__(self, sink: Sink, env: Environment):
        self.sink, self.env = sink, env
        self.opened, self.last, self.pending = False, 0, None

    def open(self) -> None:
        if not self.opened:
            self.opened = True
            _tell(self.sink, "open")

    def batch(self, df: DataFrame, number: int) -> None:
        if self.pending is not None:  # the batch before is committed once the next one begins
            _tell(self.sink, "checkpoint_complete" if number > self.pending else "checkpoint_cancelled", self.pending)
        self.pending = number
        _tell(self.sink, "checkpoint_comes", number)
        with self.env.commit_slot():
            self.sink.batch(df, number)
        self.watermark()

    def watermark(self, query: StreamingQuery | None = None) -> None:
        now = watermark_ms(query or self.query) if query or hasattr(self, "query") else None
        if now is not None and now > self.last:
            self.last = now
            _tell(self.sink, "watermark", now)

    def ended(self, query: StreamingQuery, failed: bool, again: bool) -> None:
        if self.pending is not None:
            _tell(self.sink, "checkpoint_cancelled" if failed else "checkpoint_complete", self.pending)
            self.pending = None
        if not again:
            self.watermark(query)
            _tell(self.sink, "close")


def to_sink(stream: Stream, name: str, sink: Sink, mode: str = "append", once: bool = True) -> None:
    """A sink of one's own; bounded input is one batch, number 0, and the end of time as watermark."""
    if getattr(sink, "batch", None) is None:
        raise ValueError("a sink needs a method batch")
    delivery: list[_Delivery] = []

    def start(env: Environment, location: str) -> StreamingQuery | None:
        if not delivery:
            delivery.append(_Delivery(sink, env))
        d = delivery[0]
        d.open()
        if not stream.df.isStreaming:
            d.batch(stream.df, 0)
            _tell(sink, "watermark", (1 << 63) - 1)
            _tell(sink, "checkpoint_complete", 0)
            _tell(sink, "close")
            return None
        d.query = query = env.writer(stream.df, location, mode, once).foreachBatch(d.batch).start()
        return query

    stream.environment.to_sink(stream, name, start, lambda query, failed, again: delivery[0].ended(query, failed, again))


def to_callbacks(stream: Stream, name: str, on_batch: Callable[[DataFrame, int], None], on_watermark: Callable[[int], None], mode: str = "append", once: bool = True) -> None:
    """Two callbacks as a sink; both are needed."""
    if on_batch is None or on_watermark is None:
        raise ValueError("both callbacks are needed")

    class Both(Sink):
        def batch(self, df: DataFrame, number: int) -> None:
            on_batch(df, number)

        def watermark(self, ms: int) -> None:
            on_watermark(ms)

    to_sink(stream, name, Both(), mode, once)


def to_memory(stream: Stream, name: str, mode: str = "append", once: bool = True) -> None:
    """A table in the driver's memory named like the sink: for tests."""

    def start(env: Environment, location: str) -> StreamingQuery | None:
        if not stream.df.isStreaming:
            stream.df.createOrReplaceTempView(name)
            return None
        return env.writer(stream.df, location, mode, once).format("memory").queryName(name).start()

    stream.environment.to_sink(stream, name, start)


def to_parquet(stream: Stream, name: str, path: str, partition_by: tuple[str, ...] = (), once: bool = True) -> None:
    """Parquet files, each batch committed once."""

    def start(env: Environment, location: str) -> StreamingQuery | None:
        if not stream.df.isStreaming:
            stream.df.write.partitionBy(*partition_by).mode("append").parquet(path)
            return None
        return env.writer(stream.df, location, "append", once).format("parquet").partitionBy(*partition_by).start(path)

    stream.environment.to_sink(stream, name, start)
