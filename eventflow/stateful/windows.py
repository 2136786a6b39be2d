"""Windows with allowed lateness and custom triggers, as a stateful processor.

Built-in window aggregates drop late rows by the watermark of the batch before and give one result;
this processor applies the exact rule instead: one result when the watermark passes a window's
end, one more for every late row within the lateness, and none after.  State is one
accumulator per key and window in the state store; timers fire and clean up.
"""

from __future__ import annotations

import enum
import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from eventflow.functions.aggregators import Aggregator
from eventflow.functions.windows import Tumbling
from eventflow.stream import Stream


class TriggerResult(enum.IntFlag):
    CONTINUE = 0
    FIRE = 1
    PURGE = 2
    FIRE_AND_PURGE = 3


class TriggerContext:
    """What a trigger may use for its key and window: the clock, timers of its own, and state of its own (any picklable values by name)."""

    def __init__(self, now: int, processing: bool, state: dict[str, Any], timers: set[int]):
        self.now, self.processing, self.state, self.timers = now, processing, state, timers

    def current_watermark(self) -> int | None:
        """The event-time clock; None for windows of the processing clock."""
        return None if self.processing else self.now

    def current_processing_time(self) -> int | None:
        return self.now if self.processing else None

    def register_timer(self, at: int) -> None:
        """A timer in the time of the windows; each time once."""
        self.timers.add(int(at))

    def delete_timer(self, at: int) -> None:
        self.timers.discard(int(at))


class Trigger:
    """When a window gives results; the default does so once its time has come, and for each late row after that.

    Subclasses take the short forms, or those with a context for timers and state of their own.
    """

    def on_element(self, row: dict, count: int, start: int, end: int, watermark: int) -> TriggerResult:
        return TriggerResult.FIRE if end <= watermark else TriggerResult.CONTINUE

    def on_timer(self, start: int, end: int) -> TriggerResult:
        """The window's own time."""
        return TriggerResult.FIRE

    def clear(self, start: int, end: int) -> None:
        pass

    def on_row(self, ctx: TriggerContext, row: dict, count: int, start: int, end: int) -> TriggerResult:
        return self.on_element(row, count, start, end, ctx.now)

    def on_event_timer(self, ctx: TriggerContext, at: int, start: int, end: int) -> TriggerResult:
        """A timer that the trigger registered, or (``at == end``) the window's own time."""
        return self.on_timer(start, end) if at == end else TriggerResult.CONTINUE

    def on_processing_timer(self, ctx: TriggerContext, at: int, start: int, end: int) -> TriggerResult:
        return self.on_timer(start, end) if at == end else TriggerResult.CONTINUE

    def on_clear(self, ctx: TriggerContext, start: int, end: int) -> None:
        """The window's state goes; timers of its own go with it."""
        self.clear(start, end)


class EventTimeTrigger(Trigger):
    pass


class CountTrigger(Trigger):
    """A result after every ``n`` rows, which then start anew if ``purge``."""

    def __init__(self, n: int, purge: bool = False):
        if n < 1:
            raise ValueError("a count is 1 or more")
        self.n, self.purge = n, purge

    def on_element(self, row: dict, count: int, start: int, end: int, watermark: int) -> TriggerResult:
        if count % self.n:
            return TriggerResult.CONTINUE
        return TriggerResult.FIRE_AND_PURGE if self.purge else TriggerResult.FIRE


class ProcessingTimeTrigger(Trigger):
    """Windows of a clock: results by timer only."""

    def on_element(self, row: dict, count: int, start: int, end: int, watermark: int) -> TriggerResult:
        return TriggerResult.CONTINUE


class WindowProcessor(StatefulProcessor):
    """Grouped by (keys..., start, end) in epoch milliseconds."""

    def __init__(
        self, keys: Sequence[str], aggregator: Aggregator, trigger: Trigger, lateness_ms: int, processing: bool, process: Callable[[tuple, int, int, Any], list[dict]], columns: Sequence[str],
        state: Sequence[StructField] | None = None, on_late: Callable[[tuple, int, int, dict], list[dict]] | None = None, late_rows: Any = None,
    ):
        self.keys, self.aggregator, self.trigger, self.lateness = list(keys), aggregator, trigger, lateness_ms
        self.processing, self.process, self.columns = processing, process, list(columns)
        self.state_fields, self.on_late, self.late_rows = state, on_late, late_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = self.state_fields or [StructField("acc", BinaryType())]
        own = [StructField("row_count", LongType()), StructField("was_fired", BooleanType()), StructField("of_trigger", BinaryType())]
        self.state = handle.getValueState("window", StructType([*fields, *own]))

    def close(self) -> None:
        pass

    def _get(self) -> tuple[Any, int, bool, dict[str, Any], set[int]]:
        if not self.state.exists():
            return self.aggregator.create(), 0, False, {}, set()
        *acc, count, fired, extra = self.state.get()
        if self.state_fields is None:
            acc = pickle.loads(bytes(acc[0]))  # our own state only
        of_trigger, timers = pickle.loads(bytes(extra)) if extra is not None else ({}, set())
        return acc, count, fired, of_trigger, timers

    def _put(self, acc: Any, count: int, fired: bool, ctx: TriggerContext) -> None:
        stored = (pickle.dumps(acc),) if self.state_fields is None else tuple(acc)
        extra = pickle.dumps((ctx.state, ctx.timers)) if ctx.state or ctx.timers else None
        self.state.update((*stored, count, fired, extra))

    def _now(self, timer_values) -> int:
        # Spark's watermark lags by the lateness so that state lives long enough; this is the on-time one.
        if self.processing:
            return timer_values.getCurrentProcessingTimeInMs()
        return timer_values.getCurrentWatermarkInMs() + self.lateness

    def _results(self, key: tuple, acc: Any) -> list[dict]:
        *own, start, end = key
        return [{**dict(zip(self.keys, own, strict=True)), **row, "event_ms": end - 1} for row in self.process(tuple(own), start, end, self.aggregator.result(acc))]

    def _frame(self, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.columns)

    def _timers(self, end: int) -> tuple[int, int]:
        """When to fire and when to clean up, by the clock that timers follow."""
        return (end, end) if self.processing else (end - self.lateness, end)

    def _changed(self, before: set[int], ctx: TriggerContext) -> None:
        shift = 0 if self.processing else self.lateness
        for at in ctx.timers - before:
            self.handle.registerTimer(at - shift)

    def _too_late(self, key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Dropped: counted, and told of if asked for."""
        *own, start, end = key
        out: list[dict] = []
        for pdf in rows:
            if self.late_rows is not None:
                self.late_rows.add(len(pdf))
            if self.on_late is not None:
                for row in pdf.to_dict("records"):
                    out += [{**dict(zip(self.keys, own, strict=True)), **made, "event_ms": end - 1} for made in self.on_late(tuple(own), start, end, row)]
        return self._frame(out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *_, start, end = key
        now, out = self._now(timerValues), []
        fire_at, clean_at = self._timers(end)
        if not self.processing and end + self.lateness <= now:
            return self._too_late(key, rows)
        acc, count, fired, of_trigger, timers = self._get()
        ctx, before = TriggerContext(now, self.processing, of_trigger, set(timers)), timers
        fresh = count == 0
        if not fresh and not fired and not self.processing and end <= now:
            out += self._results(key, acc)  # its timer is due in this very batch: the on-time result comes first
            fired = True
        for pdf in rows:
            for row in pdf.to_dict("records"):
                acc, count = self.aggregator.add(acc, row), count + 1
                said = self.trigger.on_row(ctx, row, count, start, end)
                if said & TriggerResult.FIRE:
                    out += self._results(key, acc)
                    fired = fired or end <= now
                if said & TriggerResult.PURGE:
                    acc = self.aggregator.create()
        self._put(acc, count, fired, ctx)
        if fresh:
            for at in {fire_at, clean_at}:
                self.handle.registerTimer(at)
        self._changed(before, ctx)
        return self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *own_key, start, end = key
        fire_at, clean_at = self._timers(end)
        due, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if not self.state.exists():
            return iter(())
        acc, count, fired, of_trigger, timers = self._get()
        ctx, before = TriggerContext(self._now(timerValues), self.processing, of_trigger, set(timers)), timers
        told = self.trigger.on_processing_timer if self.processing else self.trigger.on_event_timer
        at = due if self.processing else due + self.lateness
        said = TriggerResult.CONTINUE
        if at in ctx.timers:
            ctx.timers.discard(at)
            said |= told(ctx, at, start, end)
        if due >= fire_at and not fired:
            said |= told(ctx, end, start, end)
            fired = True
        if said & TriggerResult.FIRE:
            out += self._results(key, acc)
        if said & TriggerResult.PURGE:
            acc = self.aggregator.create()
        if due >= clean_at:
            self.trigger.on_clear(ctx, start, end)
            if (clear := getattr(self.process, "clear", None)) is not None:
                clear(tuple(own_key), start, end)
            self.state.clear()
        else:
            self._put(acc, count, fired, ctx)
            self._changed(before, ctx)
        return self._frame(out)


def stateful_window(
    df: DataFrame, spec: Tumbling, event_time: str | None, keys: Sequence[str], values: Sequence[str], aggregator: Aggregator, output: str,
    lateness_ms: int = 0, trigger: Trigger | None = None, process: Callable[[tuple, int, int, Any], list[dict]] | None = None,
    state: str | None = None, on_late: Callable[[tuple, int, int, dict], list[dict]] | None = None, late_rows: Any = None,
) -> DataFrame:
    """Windows over an unbounded stream whose watermark was assigned with the same lateness.

    ``output``: the schema of the columns that ``process`` (default: ``result`` alone) gives; keys come before, ``event_ms`` (end - 1) after.
    If ``process`` has a method ``clear(key, start, end)``, it is told when a window's state goes.  ``state``: fields of the accumulator (a
    tuple or list then), stored as typed columns; else it is stored as one value.  Rows too late for their window are dropped: ``late_rows`` (an accumulator of
    the Spark context) counts them, ``on_late(key, start, end, row)`` may give rows for them.
    """
    if lateness_ms < 0:
        raise ValueError("lateness can't be negative")
    if aggregator is None:
        raise ValueError("an aggregator is needed")
    process = process or (lambda key, start, end, result: [{"result": result}])
    trigger = trigger or (ProcessingTimeTrigger() if spec.processing else EventTimeTrigger())
    window = spec.column(event_time)
    # Only the bounds go on, not the event time: rows are judged by their window, not one by one.
    flat = df.select(*keys, F.unix_millis(window["start"]).alias("_start"), F.unix_millis(window["end"]).alias("_end"), *[c for c in values if c not in keys])
    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = ", ".join(x for x in (own, output, "event_ms long") if x)
    columns = [f.name for f in StructType.fromDDL(schema).fields]
    processor = WindowProcessor(keys, aggregator, trigger, lateness_ms, spec.processing, process, columns, StructType.fromDDL(state).fields if state else None, on_late, late_rows)
    return flat.groupBy(*keys, "_start", "_end").transformWithStateInPandas(processor, schema, "Update", "ProcessingTime" if spec.processing else "EventTime")


class TwoInputProcessor(StatefulProcessor):
    """Per key, ``left`` and ``right`` handle rows of either input with the key's own state (any value); each gives (state, rows)."""

    def __init__(self, left: Callable, right: Callable, create: Callable[[], Any], columns: Sequence[str]):
        self.by_side, self.create, self.columns = {1: left, 2: right}, create, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("both", StructType([StructField("value", BinaryType())]))

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        from eventflow.operators.multi import sides

        value = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else self.create()
        out: list[dict] = []
        for side, part in sides(rows):
            for row in part.to_dict("records"):
                value, made = self.by_side[side](key, value, row)
                out += made
        self.state.update((pickle.dumps(value),))
        if out:
            yield pd.DataFrame(out, columns=self.columns)


def co_process_stream(tagged: DataFrame, keys: Sequence[str], left: Callable, right: Callable, create: Callable[[], Any], schema: str) -> DataFrame:
    """Two unbounded inputs (see ``multi.tagged``) with state per key."""
    columns = [f.name for f in StructType.fromDDL(schema).fields]
    return tagged.groupBy(*keys).transformWithStateInPandas(TwoInputProcessor(left, right, create, columns), schema, "Append", "None")


def connect_stream(left_stream: Stream, right_stream: Stream, name: str, keys: Sequence[str], left: Callable, right: Callable, create: Callable[[], Any], schema: str) -> Stream:
    """The same as an operator of two streams."""
    from eventflow.operators import multi

    return multi.connect(left_stream, right_stream, name, lambda df: co_process_stream(df, keys, left, right, create, schema))
