"""A stream: a (bounded or unbounded) DataFrame with a name and, once assigned, an event-time column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

if TYPE_CHECKING:
    from eventflow.environment import Environment


class DifferentEnvironments(ValueError):
    """Streams of two environments can't meet."""


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    name: str
    environment: Environment | None = None
    event_time: str | None = None

    @property
    def schema(self) -> StructType:
        """The type that the stream carries."""
        return self.df.schema

    @property
    def is_bounded(self) -> bool:
        return not self.df.isStreaming

    def apply(self, name: str, fn: Callable[[DataFrame], DataFrame], event_time: str | None = None) -> Stream:
        """A one-input operator: any function of DataFrames, under a name that the environment knows once."""
        if self.environment is not None:
            self.environment.register(name, [self.name])
        out = fn(self.df)
        time = event_time or self.event_time
        return replace(self, df=out, name=name, event_time=time if time in out.columns else None)

    # The operators, for chaining

    def map(self, name: str, *columns: Column | str, **options) -> Stream:
        from eventflow.operators import basic

        return basic.map_(self, name, *columns, **options)

    def filter(self, name: str, predicate: Column, **options) -> Stream:
        from eventflow.operators import basic

        return basic.filter_(self, name, predicate, **options)

    def keep(self, name: str, predicate: Column) -> Stream:
        from eventflow.operators import basic

        return basic.keep(self, name, predicate)

    def flat_map(self, name: str, values: Column, alias: str = "value", **options) -> Stream:
        from eventflow.operators import basic

        return basic.flat_map(self, name, values, alias, **options)

    def union(self, name: str, *others: Stream) -> Stream:
        from eventflow.operators import multi

        return multi.union([self, *others], name)

    def assign_timestamps(self, name: str, timestamp: Column | str, **options) -> Stream:
        from eventflow.operators import watermark

        return watermark.assign_timestamps(self, name, timestamp, **options)

    def window(self, name: str, spec, **options) -> Stream:
        from eventflow.operators import window

        return window.aggregate(self, name, spec, **options)
