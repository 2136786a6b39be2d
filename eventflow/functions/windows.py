"""Tumbling windows as Column arithmetic: [start, end), aligned to the epoch plus an offset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tumbling:
    """Windows of ``size_ms`` shifted by ``offset_ms``, in event time or (``processing``) in the time of a clock."""

    size_ms: int
    offset_ms: int = 0
    processing: bool = False
    clock: Column | None = None

    def __post_init__(self) -> None:
        if self.size_ms < 1:
            raise ValueError("a window lasts 1 ms or more")
        if self.offset_ms < 0:
            raise ValueError("an offset can't be negative")

    def column(self, event_time: str | None) -> Column:
        """The window of a row, as Spark's own struct (so that watermarks see it)."""
        if self.processing:
            at = self.clock if self.clock is not None else F.current_timestamp()
        elif event_time is None:
            raise ValueError("event-time windows need event time: assign timestamps first")
        else:
            at = F.col(event_time)
        size = f"{self.size_ms} milliseconds"
        return F.window(at, size, size, f"{self.offset_ms % self.size_ms} milliseconds")

    def start_of(self, ms: int) -> int:
        """The same arithmetic on a number, floor division for negative times."""
        return ms - (ms - self.offset_ms % self.size_ms) % self.size_ms


def event_time(size_ms: int, offset_ms: int = 0) -> Tumbling:
    return Tumbling(size_ms, offset_ms)


def processing_time(size_ms: int, offset_ms: int = 0, clock: Column | None = None) -> Tumbling:
    return Tumbling(size_ms, offset_ms, True, clock)


def window_start_ms(ms: Column, size_ms: int, offset_ms: int = 0) -> Column:
    return ms - F.pmod(ms - F.lit(offset_ms % size_ms), F.lit(size_ms))
