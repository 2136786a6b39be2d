"""The environment: options, the graph of named operators, and the queries that run it."""

from __future__ import annotations

import enum
import logging
import re
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from eventflow.session import configure
from eventflow.stream import DifferentEnvironments, Stream

if TYPE_CHECKING:
    from eventflow.sources.logs import LogCollector
    from eventflow.sources.metrics import MetricsCollector

log = logging.getLogger("eventflow")


@dataclass(frozen=True)
class Options:
    """What a run is given; all durations in milliseconds.

    Spark commits offsets and state with every micro-batch, so a periodic checkpoint is the
    trigger interval and a minimum pause is a lower bound on it.  A query has one checkpoint pending at a time; ``max_concurrent`` bounds those that an environment's
    sinks of one's own commit side by side, and one that waits longer than ``checkpoint_timeout`` for its turn is declined, which is a failure of its query.
    ``tolerable_failures`` counts over an environment's life: so many times a query is started again from its last checkpoint, the next failure ends the run.
    """

    name: str = "eventflow"
    periodic_checkpoint: int = 0  # 0: batches follow one another
    checkpoint_dir: str = "."
    checkpoints_retained: int = 2
    min_pause: int = 0
    tolerable_failures: int = 5
    max_concurrent: int = 2
    checkpoint_timeout: int = 600_000
    buffer_size: int = 2048  # files that ``from_files`` takes into a micro-batch at most: what bounds the work in flight
    metrics_interval: int = 60_000  # how often metric and log rows go to their files (0: when read)
    log_level: int = logging.NOTSET  # of the records that a log stream gets

    def __post_init__(self) -> None:
        for name in ("periodic_checkpoint", "min_pause", "tolerable_failures", "metrics_interval"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} can't be negative")
        for name in ("checkpoints_retained", "max_concurrent", "checkpoint_timeout", "buffer_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        if not self.name:
            raise ValueError("an environment needs a name")

    @property
    def trigger_ms(self) -> int:
        return max(self.periodic_checkpoint, self.min_pause)


class Status(enum.Enum):
    READY = "ready"
    RUNNING = "running"
    CLOSING = "closing"
    CLOSED = "closed"


@dataclass
class Sink:
    name: str
    upstream: Stream
    start: Callable[[Environment, str], StreamingQuery | None]
    ended: Callable[[StreamingQuery, bool, bool], None] | None = None  # (query, failed, started again)


@dataclass
class Environment:
    spark: SparkSession
    options: Options = field(default_factory=Options)

    def __post_init__(self) -> None:
        configure(self.spark)
        self.spark.conf.set("spark.sql.streaming.minBatchesToRetain", str(self.options.checkpoints_retained))
        self.graph: dict[str, list[str]] = {}
        self.sinks: list[Sink] = []
        self.running: dict[str, StreamingQuery] = {}
        self.failures, self.errors = 0, []
        self.status = Status.READY
        self._watchers: list[threading.Thread] = []
        self._guard, self._slots = threading.Lock(), threading.BoundedSemaphore(self.options.max_concurrent)
        self._metrics = self._logs = None
        self._metric_stream = self._log_stream = None

    @property
    def queries(self) -> list[StreamingQuery]:
        return list(self.running.values())

    # Building

    def register(self, name: str, upstream: list[str]) -> None:
        """A node of the graph; names are also state keys, so each is used once."""
        if not name:
            raise ValueError("operators need a name")
        if name in self.graph:
            raise ValueError(f"the name {name!r} is taken")
        if missing := [u for u in upstream if u not in self.graph]:
            raise ValueError(f"{name!r} reads {missing}, which this environment doesn't have")
        self.graph[name] = list(upstream)

    def from_source(self, name: str, source: DataFrame | Callable[[SparkSession], DataFrame], event_time: str | None = None) -> Stream:
        self.register(name, [])
        return Stream(source if isinstance(source, DataFrame) else source(self.spark), name, self, event_time)

    def from_files(self, name: str, path: str, schema: StructType | str | None = None, fmt: str = "parquet", event_time: str | None = None) -> Stream:
        """An unbounded source of a folder's files, ``buffer_size`` of them in a batch at most."""
        from eventflow.sources import files

        return self.from_source(name, files.read_stream(self.spark, path, schema, fmt, self.options.buffer_size), event_time)

    def to_sink(self, upstream: Stream, name: str, start: Callable[[Environment, str], StreamingQuery | None], ended: Callable[[StreamingQuery, bool, bool], None] | None = None) -> None:
        if upstream.environment is not self:
            raise DifferentEnvironments(f"{upstream.name!r} belongs to another environment")
        self.register(name, [upstream.name])
        self.sinks.append(Sink(name, upstream, start, ended))

    def validate(self) -> None:
        """Every branch ends in a sink and there is something to run."""
        if not self.sinks:
            raise ValueError("nothing to run: no sink")
        read = {u for ups in self.graph.values() for u in ups}
        ends = {s.name for s in self.sinks}
        if loose := [n for n in self.graph if n not in read and n not in ends]:
            raise ValueError(f"no sink reads {loose}")

    # Running

    def start(self, supervised: bool = False) -> Environment:
        """Run all sinks; with ``supervised``, a query that fails is started again for as many failures as are tolerable."""
        self.validate()
        if self.status is not Status.READY:
            raise RuntimeError(f"an environment starts once; this one is {self.status.value}")
        self.status = Status.RUNNING
        for sink in self.sinks:
            query = sink.start(self, self.checkpoint_location(sink.name))
            if query is not None:
                self.running[sink.name] = query
                watcher = threading.Thread(target=self._watch, args=(sink, supervised), daemon=True, name=f"eventflow-{sink.name}")
                self._watchers.append(watcher)
                watcher.start()
        return self

    def _watch(self, sink: Sink, supervised: bool) -> None:
        while True:
            query, error = self.running[sink.name], None
            try:
                query.awaitTermination()
            except Exception as e:  # whatever ends a query
                error = e
                log.error("query %s failed: %s", sink.name, e)
            with self._guard:
                again = False
                if error is not None:
                    self.failures += 1
                    again = supervised and self.status is Status.RUNNING and self.failures <= self.options.tolerable_failures
                    if not again:
                        self.errors.append(error)
            if sink.ended is not None:
                sink.ended(query, error is not None, again)
            if not again:
                break
            self.running[sink.name] = sink.start(self, self.checkpoint_location(sink.name))
        if error is not None and supervised and self.status is Status.RUNNING:
            for other in self.queries:  # failures aren't tolerable any more: the run ends
                other.stop()

    def wait(self, timeout: float | None = None) -> bool:
        """Until all queries have ended and their sinks have heard of it; the first error that ended one is raised."""
        deadline = None if timeout is None else time.monotonic() + timeout
        for w in self._watchers:
            w.join(None if deadline is None else max(0.0, deadline - time.monotonic()))
        ended = not any(w.is_alive() for w in self._watchers)
        if ended and self.status is Status.RUNNING:
            self.status = Status.CLOSED
        if self.errors:
            raise self.errors[0]
        return ended

    @contextmanager
    def commit_slot(self) -> Iterator[None]:
        """One of ``max_concurrent`` places for batches that are being committed."""
        if not self._slots.acquire(timeout=self.options.checkpoint_timeout / 1000):
            raise TimeoutError(f"declined: no checkpoint of {self.options.max_concurrent} pending ones ended within {self.options.checkpoint_timeout} ms")
        try:
            yield
        finally:
            self._slots.release()

    def checkpoint_location(self, sink: str) -> str:
        """Below the options' folder, or where that is left open, below the one that the cluster names for checkpoints."""
        folder = self.options.checkpoint_dir
        if folder == ".":
            folder = self.spark.conf.get("spark.checkpoint.dir", None) or folder
        return f"{folder.rstrip('/')}/{self.options.name}/{re.sub(r'[^A-Za-z0-9_.-]', '_', sink)}"

    def writer(self, df: DataFrame, location: str, mode: str = "append", once: bool = False):
        """A stream writer with this environment's trigger and checkpoint place."""
        out = df.writeStream.outputMode(mode).option("checkpointLocation", location)
        if once:
            return out.trigger(availableNow=True)
        return out.trigger(processingTime=f"{self.options.trigger_ms} milliseconds") if self.options.trigger_ms else out

    def drain(self) -> None:
        """Wait until all that sources have now is processed."""
        for q in self.queries:
            q.processAllAvailable()

    def stop(self, savepoint: bool = False, timeout: float = 60.0) -> None:
        """End all queries; with ``savepoint``, after what is available has been processed and committed."""
        deadline = time.monotonic() + timeout
        self.status = Status.CLOSING
        for q in self.queries:
            if savepoint and q.isActive:
                q.processAllAvailable()
            q.stop()
        for w in self._watchers:
            w.join(max(1.0, deadline - time.monotonic()))
        self.status = Status.CLOSED

    @property
    def done(self) -> bool:
        return all(not q.isActive for q in self.queries)

    # Streams about the run itself

    @property
    def metrics(self) -> MetricsCollector:
        """Progress of every query; it is recorded from when this is first asked for."""
        if self._metrics is None:
            from eventflow.sources.metrics import MetricsCollector

            self._metrics = MetricsCollector(self.spark, self.checkpoint_location("metrics-rows"), self.options.metrics_interval)
        return self._metrics

    @property
    def logs(self) -> LogCollector:
        """Log records, from when this is first asked for."""
        if self._logs is None:
            from eventflow.sources.logs import LogCollector

            self._logs = LogCollector(self.spark, self.checkpoint_location("log-rows"), self.options.metrics_interval)
            self._logs.setLevel(self.options.log_level)
        return self._logs

    def metrics_stream(self) -> Stream:
        """The metrics as an unbounded stream of this environment: the same one each time."""
        if self._metric_stream is None:
            self._metric_stream = self.from_source("metrics", self.metrics.live(), event_time="at")
        return self._metric_stream

    def log_stream(self) -> Stream:
        """The log records as an unbounded stream of this environment: the same one each time."""
        if self._log_stream is None:
            self._log_stream = self.from_source("log", self.logs.live(), event_time="time")
        return self._log_stream
