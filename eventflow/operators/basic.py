"""Row-wise operators: map, filter, keep, flat_map.

Column expressions stay inside Catalyst: projections prune columns and predicates reach the
scan.  A Python function is taken too; it runs over Arrow batches, once opened per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from eventflow.stream import Stream


class Rich(Protocol):
    """Set up before a partition's first row, torn down after its last."""

    def open(self) -> None: ...

    def close(self) -> None: ...


def in_partitions(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, rich: Rich | None = None) -> DataFrame:
    """``fn`` over batches of rows, between ``rich.open`` and ``rich.close`` of each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if rich is not None:
            rich.open()
        try:
            for pdf in batches:
                yield fn(pdf)
        finally:
            if rich is not None:
                rich.close()

    return df.mapInPandas(run, schema)


def hooked(df: DataFrame, rich: Rich | None) -> DataFrame:
    """The same rows, between ``rich.open`` and ``rich.close`` of each partition: for operators that are Column expressions otherwise."""
    if rich is None:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rich.open()
        try:
            yield from batches
        finally:
            rich.close()

    return df.mapInArrow(run, df.schema)


def _needed(fn: object, what: str) -> None:
    if fn is None:
        raise ValueError(f"{what} needs a function")


def map_(stream: Stream, name: str, *columns: Column | str, fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: StructType | str | None = None, rich: Rich | None = None) -> Stream:
    """One row out for each row in: ``columns`` of it, or ``fn`` of its batch with ``schema``."""
    if columns:
        return stream.apply(name, lambda df: hooked(df.select(*columns), rich))
    _needed(fn, "map")
    _needed(schema, "map with a Python function")

    def same_length(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf)
        if len(out) != len(pdf):
            raise ValueError(f"map gave {len(out)} rows for {len(pdf)}")
        return out

    return stream.apply(name, lambda df: in_partitions(df, same_length, schema, rich))


_COMPARISONS = frozenset(("EqualTo", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "StartsWith", "EndsWith", "Contains"))


def _compared(df: DataFrame, predicate: Column) -> list[str] | None:
    """The columns that a single comparison of columns and constants reads (it is null exactly if one of them is); None for anything else."""
    try:
        expression = df.select(predicate.alias("p"))._jdf.queryExecution().analyzed().projectList().head().child()
    except AttributeError:  # a client without the plan at hand
        return None
    if expression.getClass().getSimpleName() not in _COMPARISONS:
        return None
    names, children = [], expression.children()
    for i in range(children.size()):
        child = children.apply(i)
        if child.getClass().getSimpleName() == "AttributeReference":
            names.append(child.name())
        elif not child.foldable() or child.nullable():
            return None
    return names if names and all(df.columns.count(n) == 1 for n in names) else None


def not_true(df: DataFrame, predicate: Column) -> Column:
    """True where the predicate is false or null, in a form that reaches the scan where the predicate is a plain comparison."""
    if (names := _compared(df, predicate)) is None:
        return ~F.coalesce(predicate, F.lit(False))
    return reduce(lambda a, b: a | b, [F.col("`" + n.replace("`", "``") + "`").isNull() for n in names]) | ~predicate


def filter_(stream: Stream, name: str, predicate: Column | None = None, fn: Callable[[pd.DataFrame], Any] | None = None, rich: Rich | None = None) -> Stream:
    """Drops the rows for which the predicate is true; rows for which it is false or null pass."""
    if predicate is not None:
        return stream.apply(name, lambda df: hooked(df.where(not_true(df, predicate)), rich))
    _needed(fn, "filter")
    return stream.apply(name, lambda df: in_partitions(df, lambda pdf: pdf[~pd.Series(fn(pdf), index=pdf.index).fillna(False).astype(bool)], df.schema, rich))


def keep(stream: Stream, name: str, predicate: Column) -> Stream:
    """Keeps the rows for which the predicate is true."""
    return stream.apply(name, lambda df: df.where(predicate))


def flat_map(stream: Stream, name: str, values: Column | None = None, alias: str = "value", keep_columns: bool = True, fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: StructType | str | None = None, rich: Rich | None = None) -> Stream:
    """A row for each element of ``values``, none for an empty or null array; the event time is inherited."""
    if values is not None:

        def explode(df: DataFrame) -> DataFrame:
            rest = [F.col(f"`{c}`") for c in df.columns if c != alias] if keep_columns else ([F.col(stream.event_time)] if stream.event_time else [])
            return df.select(*rest, F.explode(values).alias(alias))

        return stream.apply(name, lambda df: hooked(explode(df), rich))
    _needed(fn, "flat_map")
    _needed(schema, "flat_map with a Python function")
    return stream.apply(name, lambda df: in_partitions(df, fn, schema, rich))


def is_predicate(df: DataFrame, predicate: Column) -> bool:
    return isinstance(df.select(predicate.alias("p")).schema["p"].dataType, BooleanType)
