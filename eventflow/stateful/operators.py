"""Operators of one's own: keyed state, timers, checkpoints, one or two inputs, and watermarks made by generators.

An ``Operator`` handles the rows of one or two inputs key by key.  It has named state, timers in event
and in processing time, and hears of watermarks, of inputs that fall idle, and of checkpoints.

Each input has a generator of watermarks (bounded out-of-orderness, none, with idleness, or one's own); a key's watermark is the least over
its inputs that aren't idle, and never falls.  When it rises, timers that are due fire first, in order, and then the operator hears of it.

On bounded input a key's rows come in the order of event time (or of ``order``), read as a stream: a key of any size is never held
whole, only its state is.  The end of input is a last watermark at the end of time.  On unbounded input rows come batch by batch, the state of a key is
one value in the state store, and timers wake it up.
"""

from __future__ import annotations

import logging
import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from eventflow.operators.multi import SIDE, tagged
from eventflow.stateful.timers import BoundedOutOfOrderness, CombinedWatermark, Monotone, Timer, TimerQueue
from eventflow.stream import DifferentEnvironments, Stream

END_OF_TIME = (1 << 63) - 1


# Watermarks


class Collector(Monotone):
    """What a generator emits to: watermarks that rise, and whether the input is idle."""

    def mark_active(self) -> bool:
        changed, self.idle = self.idle, False
        return changed


class Generator:
    """Makes the watermarks of an input: at any row, or from time to time."""

    def on_event(self, row: dict, timestamp: int, out: Collector) -> None:
        pass

    def on_periodic(self, out: Collector, now: int) -> None:
        pass


class Bounded(Generator):
    """Rows are at most ``ms`` out of order."""

    def __init__(self, ms: int = 0):
        self.inner = BoundedOutOfOrderness(ms)

    def on_event(self, row: dict, timestamp: int, out: Collector) -> None:
        self.inner.on_event(timestamp)

    def on_periodic(self, out: Collector, now: int) -> None:
        out.emit(self.inner.current())


class Never(Generator):
    """No watermark but the last one: event-time timers wait for the end of input."""


class Idle(Generator):
    """``inner``, and idle once no row has come for ``idle_ms``: then the input holds no other back."""

    def __init__(self, inner: Generator, idle_ms: int):
        if inner is None or idle_ms < 0:
            raise ValueError("idleness needs a generator and a time of 0 or more")
        self.inner, self.idle_ms, self.last = inner, idle_ms, None
        self._fresh = False

    def on_event(self, row: dict, timestamp: int, out: Collector) -> None:
        self._fresh = True
        out.mark_active()
        self.inner.on_event(row, timestamp, out)

    def on_periodic(self, out: Collector, now: int) -> None:
        if self._fresh or self.last is None:
            self._fresh, self.last = False, now
        if now - self.last >= self.idle_ms and now > self.last:
            out.mark_idle()
        else:
            self.inner.on_periodic(out, now)


# What an operator gets


class Cell:
    """A named value of a key's state."""

    def __init__(self, values: dict[str, Any], name: str):
        self._values, self._name = values, name

    def get(self) -> Any:
        return self._values[self._name]

    def set(self, value: Any) -> None:
        self._values[self._name] = value

    def clear(self) -> None:
        self._values.pop(self._name, None)


class State:
    """A key's state by name: any picklable values, lists and dicts among them."""

    def __init__(self, values: dict[str, Any]):
        self._values = values

    def register_or_get(self, name: str, default: Callable[[], Any]) -> Cell:
        if name not in self._values:
            self._values[name] = default()
        return Cell(self._values, name)

    def __contains__(self, name: str) -> bool:
        return name in self._values

    def names(self) -> list[str]:
        return sorted(self._values)

    def clear(self) -> None:
        self._values.clear()


@dataclass
class TimerService:
    """Timers of a key under a name; each (payload, time) once."""

    event: TimerQueue = field(default_factory=TimerQueue)
    processing: TimerQueue = field(default_factory=TimerQueue)
    watermark: int = 0
    now: int = 0

    def current_watermark(self) -> int:
        return self.watermark

    def current_processing_time(self) -> int:
        return self.now

    def register_event_timer(self, payload: Any, at: int) -> bool:
        return self.event.add(Timer(payload, int(at)))

    def register_processing_timer(self, payload: Any, at: int) -> bool:
        return self.processing.add(Timer(payload, int(at)))

    def delete_event_timer(self, payload: Any, at: int) -> bool:
        return self.event.remove(Timer(payload, int(at)))

    def delete_processing_timer(self, payload: Any, at: int) -> bool:
        return self.processing.remove(Timer(payload, int(at)))


class Metrics:
    """Counts that an operator makes, by name: accumulators of the Spark context, so that the driver can read them."""

    def __init__(self, counters: dict[str, Any]):
        self._counters = counters

    def count(self, name: str, n: int = 1) -> None:
        if name in self._counters:
            self._counters[name].add(n)


class Context:
    """What an operator may use while it handles a key."""

    def __init__(self, key: tuple, values: dict[str, Any], services: dict[str, TimerService], metrics: Metrics, name: str):
        self.key, self.state, self.metrics = key, State(values), metrics
        self.logger = logging.getLogger(f"eventflow.operator.{name}")
        self._services, self._jobs = services, []

    def timer_service(self, name: str = "timers") -> TimerService:
        return self._services.setdefault(name, TimerService())

    def exec(self, job: Callable[[], None]) -> None:
        """Run ``job`` after what is being handled now, and before anything else is."""
        self._jobs.append(job)

    def run_jobs(self) -> None:
        while self._jobs:
            self._jobs.pop(0)()


class Operator:
    """The base of operators of one's own; what gives rows gives dicts of the output's columns."""

    def open(self) -> None:
        """Once per task, before the first row."""

    def close(self) -> None:
        """Once per task, after the last row."""

    def process(self, ctx: Context, row: dict) -> Iterable[dict] | None:
        raise NotImplementedError("an operator handles rows: define process")

    def process_right(self, ctx: Context, row: dict) -> Iterable[dict] | None:
        raise NotImplementedError("an operator of two inputs handles rows of the second: define process_right")

    def on_event_time(self, ctx: Context, timer: Timer) -> Iterable[dict] | None:
        return ()

    def on_processing_time(self, ctx: Context, timer: Timer) -> Iterable[dict] | None:
        return ()

    def on_watermark(self, ctx: Context, watermark: int) -> Iterable[dict] | None:
        return ()

    def on_status(self, ctx: Context, idle: bool) -> Iterable[dict] | None:
        """All inputs have fallen idle, or no longer are."""
        return ()

    def on_checkpoint(self, ctx: Context) -> None:
        """The key's state is about to be stored with the batch."""


class KeyRun:
    """An operator at work on one key."""

    def __init__(self, operator: Operator, generators: Sequence[Callable[[], Generator]], key: tuple, metrics: Metrics, name: str, saved: bytes | None = None):
        self.operator = operator
        if saved is None:
            inputs = len(generators)
            self.values, self.services, self.generators = {}, {}, [make() for make in generators]
            self.collectors, self.combined, self.was_idle = [Collector() for _ in range(inputs)], CombinedWatermark(inputs), True
        else:
            self.values, self.services, self.generators, self.collectors, self.combined, self.was_idle = pickle.loads(saved)  # our own state only
        self.ctx = Context(key, self.values, self.services, metrics, name)

    def save(self) -> bytes:
        self.operator.on_checkpoint(self.ctx)
        return pickle.dumps((self.values, self.services, self.generators, self.collectors, self.combined, self.was_idle))

    def _ran(self, rows: Iterable[dict] | None) -> Iterator[dict]:
        yield from rows or ()
        self.ctx.run_jobs()

    def clock(self, now: int) -> Iterator[dict]:
        """Processing time: timers that are due fire in order."""
        while due := [(s.processing.peek().timestamp, k) for k, s in self.services.items() if s.processing.peek() and s.processing.peek().timestamp <= now]:
            service = self.services[min(due)[1]]
            for s in self.services.values():
                s.now = max(s.now, min(due)[0])
            yield from self._ran(self.operator.on_processing_time(self.ctx, service.processing.pop()))
        for s in self.services.values():
            s.now = max(s.now, now)

    def row(self, side: int, row: dict, timestamp: int | None, now: int) -> Iterator[dict]:
        self.ctx.timer_service().now = max(self.ctx.timer_service().now, now)
        handle = self.operator.process_right if side == 2 else self.operator.process
        yield from self._ran(handle(self.ctx, row))
        if timestamp is not None:
            collector = self.collectors[side - 1]
            was, idle = collector.last, collector.idle
            self.generators[side - 1].on_event(row, timestamp, collector)
            if collector.last != was or collector.idle != idle:
                yield from self._told(side)

    def periodic(self, now: int) -> Iterator[dict]:
        for side, (generator, collector) in enumerate(zip(self.generators, self.collectors, strict=True), 1):
            was, idle = collector.last, collector.idle
            generator.on_periodic(collector, now)
            if collector.last != was or collector.idle != idle:
                yield from self._told(side)

    def _told(self, side: int) -> Iterator[dict]:
        collector = self.collectors[side - 1]
        before = self.combined.watermark
        if collector.idle:
            self.combined.update_idle(side)
        elif collector.last > 0:
            self.combined.update(side, collector.last)
        if self.combined.watermark > before:
            yield from self.advance(self.combined.watermark)
        if self.combined.is_idle != self.was_idle:
            self.was_idle = self.combined.is_idle
            yield from self._ran(self.operator.on_status(self.ctx, self.was_idle))

    def advance(self, watermark: int) -> Iterator[dict]:
        """Event time: timers that are due fire in order, then the operator hears of the watermark."""
        for s in self.services.values():
            s.watermark = max(s.watermark, watermark)
        while due := [(s.event.peek().timestamp, k) for k, s in self.services.items() if s.event.peek() and s.event.peek().timestamp <= watermark]:
            yield from self._ran(self.operator.on_event_time(self.ctx, self.services[min(due)[1]].event.pop()))
        self.ctx.timer_service().watermark = max(self.ctx.timer_service().watermark, watermark)
        yield from self._ran(self.operator.on_watermark(self.ctx, watermark))

    def next_wake(self) -> int | None:
        """When processing time matters next: a timer, or an input that may fall idle."""
        times = [s.processing.peek().timestamp for s in self.services.values() if s.processing.peek()]
        times += [g.last + g.idle_ms for g, c in zip(self.generators, self.collectors, strict=True) if isinstance(g, Idle) and g.last is not None and not c.idle]
        return min(times, default=None)


@dataclass(frozen=True)
class _Plan:
    """What tasks need to know."""

    operator: Operator
    generators: tuple[Callable[[], Generator], ...]
    keys: tuple[str, ...]
    name: str
    metrics: Metrics
    emit_every: int
    finish: bool


#: Columns beside the rows' own: event time and processing time in milliseconds (Spark renames columns that begin with an underscore).
AT, NOW = "eventflow_at", "eventflow_now"


def _bounded(df: DataFrame, plan: _Plan, order: Sequence[str], schema: StructType) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan.operator.open()
        try:
            key, keyed, out, tick = None, None, [], 0
            for rb in batches:
                for row in rb.to_pylist():
                    at, now, side = row.pop(AT), row.pop(NOW), row.pop(SIDE, 1)
                    now = now if now is not None else at if at is not None else 0
                    if (own := tuple(row[k] for k in plan.keys)) != key or keyed is None:
                        if keyed is not None and plan.finish:
                            out += keyed.advance(END_OF_TIME)
                        key, keyed, tick = own, KeyRun(plan.operator, plan.generators, own, plan.metrics, plan.name), now
                    if plan.emit_every:
                        # of the ticks since the last row, the first sees that row and the last the silence after it
                        ticks = sorted({tick + plan.emit_every, now - (now - tick) % plan.emit_every}) if now - tick >= plan.emit_every else []
                        for t in ticks:
                            out += keyed.clock(t)
                            out += keyed.periodic(t)
                            tick = t
                    out += keyed.clock(now)
                    out += keyed.row(side, row, at, now)
                    if not plan.emit_every:
                        out += keyed.periodic(now)
                    if len(out) >= 4096:
                        yield batch(out)
                        out = []
            if keyed is not None and plan.finish:
                out += keyed.advance(END_OF_TIME)
            yield batch(out)
        finally:
            plan.operator.close()

    sides = [SIDE] if SIDE in df.columns else []
    return df.repartition(*plan.keys).sortWithinPartitions(*plan.keys, *order, *sides).mapInArrow(run, schema)


class KeyedProcessor(StatefulProcessor):
    """The same on unbounded input, a key's state in the state store."""

    def __init__(self, plan: _Plan, order: Sequence[str], columns: Sequence[str]):
        self.plan, self.order, self.columns = plan, list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("key", StructType([StructField("saved", BinaryType())]))
        self.plan.operator.open()

    def close(self) -> None:
        self.plan.operator.close()

    def _run(self, key: tuple) -> KeyRun:
        saved = bytes(self.state.get()[0]) if self.state.exists() else None
        return KeyRun(self.plan.operator, self.plan.generators, tuple(key), self.plan.metrics, self.plan.name, saved)

    def _done(self, keyed: KeyRun, out: list[dict], now: int) -> Iterator[pd.DataFrame]:
        self.state.update((keyed.save(),))
        if (wake := keyed.next_wake()) is not None:
            self.handle.registerTimer(max(wake, now + 1))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, keyed = timerValues.getCurrentProcessingTimeInMs(), self._run(key)
        out = list(keyed.clock(now))
        for pdf in rows:  # ordered within what comes at a time
            pdf = pdf.sort_values(self.order) if self.order else pdf
            for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                at, side = row.pop(AT), row.pop(SIDE, 1)
                row.pop(NOW, None)
                out += keyed.row(int(side), row, at, now)
        out += keyed.periodic(now)
        yield from self._done(keyed, out, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, keyed = timerValues.getCurrentProcessingTimeInMs(), self._run(key)
        out = [*keyed.clock(now), *keyed.periodic(now)]
        yield from self._done(keyed, out, now)


def _apply(
    df: DataFrame, name: str, keys: Sequence[str], operator: Operator, schema: str, event_time: str | None, generators: Sequence[Callable[[], Generator]],
    order: Sequence[str], clock: str | None, emit_every_ms: int, finish: bool, counters: dict[str, Any] | None,
) -> DataFrame:
    if not isinstance(operator, Operator):
        raise ValueError("an operator is needed")
    if not keys:
        raise ValueError("keys are needed")
    if emit_every_ms < 0:
        raise ValueError("an interval can't be negative")
    plan = _Plan(operator, tuple(generators), tuple(keys), name, Metrics(counters or {}), emit_every_ms, finish)
    made = StructType.fromDDL(schema)
    at = F.unix_millis(F.col(event_time).cast("timestamp")) if event_time else F.lit(None).cast("long")
    rest = [c for c in df.columns if c != event_time]
    flat = df.select(*rest, at.alias(AT), (F.col(clock).cast("long") if clock else F.lit(None).cast("long")).alias(NOW))
    by = list(order) or [AT]
    if df.isStreaming:
        return flat.groupBy(*keys).transformWithStateInPandas(KeyedProcessor(plan, by, [f.name for f in made.fields]), made, "Append", "ProcessingTime")
    return _bounded(flat, plan, by, made)


def process(
    stream: Stream, name: str, keys: Sequence[str], operator: Operator, schema: str, generator: Callable[[], Generator] = Bounded, order: Sequence[str] = (), clock: str | None = None,
    emit_every_ms: int = 0, finish: bool = True, counters: dict[str, Any] | None = None,
) -> Stream:
    """An operator of one's own on one input.

    ``order``: columns that give the order of rows (default: event time).  ``clock``: a column with processing time in milliseconds, for bounded input (default:
    event time).  ``emit_every_ms``: how often generators are asked for a watermark (0: after each row; unbounded input: with each batch).  ``finish``: whether bounded input
    ends with a last watermark.  ``counters``: accumulators by name, for ``ctx.metrics``.
    """
    return stream.apply(name, lambda df: _apply(df, name, keys, operator, schema, stream.event_time, [generator], order, clock, emit_every_ms, finish, counters))


def process_two(
    left: Stream, right: Stream, name: str, keys: Sequence[str], operator: Operator, schema: str, generators: tuple[Callable[[], Generator], Callable[[], Generator]] = (Bounded, Bounded),
    order: Sequence[str] = (), clock: str | None = None, emit_every_ms: int = 0, finish: bool = True, counters: dict[str, Any] | None = None,
) -> Stream:
    """The same on two inputs, which may differ in columns: rows of the second go to ``process_right``."""
    if left.environment is not right.environment:
        raise DifferentEnvironments(f"the inputs of {name!r} belong to several environments")
    if left.environment is not None:
        left.environment.register(name, [left.name, right.name])
    if left.event_time != right.event_time:
        raise ValueError("both inputs need the same event-time column, or none")
    out = _apply(tagged(left, right), name, keys, operator, schema, left.event_time, generators, order, clock, emit_every_ms, finish, counters)
    return replace(left, df=out, name=name, event_time=None)
