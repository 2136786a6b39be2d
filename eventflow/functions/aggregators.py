"""User-defined window aggregates.

Built-in aggregates (``F.sum`` ...) combine before the shuffle and are the first choice.
``fold`` expresses an order-dependent accumulator in Catalyst; ``Aggregator`` is a Python one for
stateful windows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Aggregator(Protocol):
    """An accumulator: its start, a row added, and the result for the window."""

    def create(self) -> Any: ...

    def add(self, acc: Any, row: dict) -> Any: ...

    def result(self, acc: Any) -> Any: ...


def fold(order: Column, value: Column, zero: Column, add: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    """An aggregate that adds a window's values one by one in ``order``.

    A window's values meet in one array, so this is for aggregates that can't be merged.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.aggregate(ordered, zero, lambda acc, x: add(acc, x["v"]), finish) if finish else F.aggregate(ordered, zero, lambda acc, x: add(acc, x["v"]))
