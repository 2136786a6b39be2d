"""Timers and watermarks as plain objects: what stateful processors and tests reason with."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Generic, TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class Timer(Generic[T]):
    payload: T
    timestamp: int


class TimerQueue(Generic[T]):
    """Timers by time, each (payload, timestamp) once; equal times in the order they came."""

    def __init__(self) -> None:
        self._heap: list[tuple[int, int, Timer[T]]] = []
        self._known: set[Timer[T]] = set()
        self._n = 0

    def __len__(self) -> int:
        return len(self._known)

    def add(self, timer: Timer[T]) -> bool:
        """False if it is there already."""
        if timer in self._known:
            return False
        self._known.add(timer)
        heapq.heappush(self._heap, (timer.timestamp, self._n, timer))
        self._n += 1
        return True

    def peek(self) -> Timer[T] | None:
        while self._heap and self._heap[0][2] not in self._known:
            heapq.heappop(self._heap)
        return self._heap[0][2] if self._heap else None

    def pop(self) -> Timer[T] | None:
        if (head := self.peek()) is not None:
            heapq.heappop(self._heap)
            self._known.discard(head)
        return head

    def remove(self, timer: Timer[T]) -> bool:
        """True if it was the next one due."""
        head = self.peek()
        self._known.discard(timer)
        return head is not None and head == timer

    def advance(self, now: int) -> Iterator[Timer[T]]:
        """Takes out all that are due, in order."""
        while (head := self.peek()) is not None and head.timestamp <= now:
            yield self.pop()


@dataclass
class BoundedOutOfOrderness:
    """The watermark of events at most ``ms`` out of order: the latest time less ``ms`` less 1 (it is inclusive)."""

    ms: int
    latest: int | None = None

    def __post_init__(self) -> None:
        if self.ms < 0:
            raise ValueError("out-of-orderness can't be negative")

    def on_event(self, timestamp: int) -> None:
        self.latest = timestamp if self.latest is None else max(self.latest, timestamp)

    def current(self) -> int | None:
        return None if self.latest is None else self.latest - self.ms - 1


@dataclass
class Monotone:
    """Lets through only watermarks above zero that rise; emitting one marks the stream active."""

    last: int = 0
    idle: bool = False

    def emit(self, watermark: int | None) -> bool:
        if watermark is None or watermark <= self.last:
            return False
        self.last, self.idle = watermark, False
        return True

    def mark_idle(self) -> bool:
        changed, self.idle = not self.idle, True
        return changed


@dataclass
class WithIdleness:
    """A generator that reports a stream idle once nothing came for ``idle_ms``."""

    generator: BoundedOutOfOrderness
    idle_ms: int
    _last: int | None = None

    def on_event(self, timestamp: int, now: int) -> None:
        self.generator.on_event(timestamp)
        self._last = now

    def is_idle(self, now: int) -> bool:
        if self._last is None:
            self._last = now
        return now - self._last >= self.idle_ms


@dataclass
class CombinedWatermark:
    """The watermark of several inputs: the least over those that aren't idle; it never falls.  Inputs (from 1) start idle."""

    inputs: int
    watermark: int = 0
    _each: list[int] = field(default_factory=list)
    _idle: list[bool] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.inputs < 1:
            raise ValueError("one input or more")
        self._each, self._idle = [0] * self.inputs, [True] * self.inputs

    @property
    def is_idle(self) -> bool:
        return all(self._idle)

    def update(self, number: int, watermark: int) -> bool:
        """True if the combined watermark rises."""
        self._each[number - 1] = max(self._each[number - 1], watermark)
        self._idle[number - 1] = False
        return self._combine()

    def update_idle(self, number: int, idle: bool = True) -> bool:
        self._idle[number - 1] = idle
        return self._combine()

    def _combine(self) -> bool:
        live = [w for w, idle in zip(self._each, self._idle, strict=True) if not idle]
        if not live or min(live) <= self.watermark:
            return False
        self.watermark = min(live)
        return True
