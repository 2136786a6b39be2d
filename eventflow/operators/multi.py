"""Operators of several inputs: union, and two inputs of different types."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BooleanType, ByteType, IntegerType, LongType, ShortType, StructType

from eventflow.operators.basic import Rich, hooked
from eventflow.stream import DifferentEnvironments, Stream

#: 1 or 2: the input that a connected row came from.
SIDE = "input_side"


def _together(streams: list[Stream], name: str) -> None:
    if len(streams) < 2:
        raise ValueError(f"{name!r} needs two inputs or more")
    env = streams[0].environment
    if any(s.environment is not env for s in streams):
        raise DifferentEnvironments(f"the inputs of {name!r} belong to several environments")
    if env is not None:
        env.register(name, [s.name for s in streams])


def union(streams: list[Stream], name: str, rich: Rich | None = None) -> Stream:
    """All rows of all inputs (same columns), duplicates included, in no order; the watermark is the least of the inputs'.

    On unbounded input one that stays silent holds that watermark back; ``stateful.operators`` has watermarks by key that leave out idle inputs.
    """
    name = f"operator.{name}"
    _together(streams, name)
    first = streams[0]
    kinds = {tuple((f.name, f.dataType.simpleString()) for f in sorted(s.schema.fields, key=lambda f: f.name)) for s in streams}
    if len(kinds) > 1:
        raise TypeError(f"the inputs of {name!r} differ in type")
    time = first.event_time if all(s.event_time == first.event_time for s in streams) else None
    return replace(first, df=hooked(reduce(DataFrame.unionByName, (s.df for s in streams)), rich), name=name, event_time=time)


def tagged(left: Stream, right: Stream, columns: Iterable[str] = ()) -> DataFrame:
    """Both inputs in one DataFrame with SIDE; columns that one lacks are null there."""
    a, b = left.df.withColumn(SIDE, F.lit(1)), right.df.withColumn(SIDE, F.lit(2))
    out = a.unionByName(b, allowMissingColumns=True)
    return out.select(SIDE, *columns) if columns else out


def connect(left: Stream, right: Stream, name: str, fn: Callable[[DataFrame], DataFrame]) -> Stream:
    """A two-input operator as a function of the tagged rows: columns and aggregates stay in Catalyst."""
    _together([left, right], name)
    out = fn(tagged(left, right))
    time = left.event_time if left.event_time and left.event_time in out.columns else None
    return replace(left, df=out, name=name, event_time=time)


def co_process(left: Stream, right: Stream, name: str, key: list[str], fn: Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame | Iterable[tuple]], schema: StructType | str) -> Stream:
    """Bounded inputs: ``fn(key, rows of the left, rows of the right)`` per key gives a DataFrame, or tuples in the order of ``schema`` (much cheaper where keys have few rows).

    Both inputs pass a task sorted by key, many keys to a batch; a task holds a batch and the rows of one key.
    """
    _together([left, right], name)
    return replace(left, df=_by_key(left.df, right.df, key, fn, schema), name=name, event_time=None)


_WHOLE = (ByteType, ShortType, IntegerType, LongType, BooleanType)


def _by_key(left: DataFrame, right: DataFrame, key: list[str], fn: Callable, schema: StructType | str) -> DataFrame:
    """``fn`` gets the frames that a cogroup of Spark would give it, types included: nulls among whole numbers make floats of a key's column, but of no other key's.

    Within nested values that can't be told afterwards, so inputs with such columns are left to Spark's cogroup.
    """
    made = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    outs, first, keys = made.fieldNames(), "_first", [f"_k{i}" for i in range(len(key))]
    if not all(isinstance(f.dataType, AtomicType) for df in (left, right) for f in df.schema):

        def framed(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            got = fn(k, a, b)
            return got if isinstance(got, pd.DataFrame) else pd.DataFrame(got, columns=outs, dtype=object)

        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(framed, made)
    same = [a.dataType == b.dataType for a, b in zip(left.select(*key).schema, right.select(*key).schema, strict=True)]
    flat, labels, places = [], [], []  # each side's columns, their names, and where they are: a column that is a key goes but once
    for side, df in enumerate((left, right)):
        own = [keys[key.index(c)] if c in key and same[key.index(c)] else f"_s{side}_{i}" for i, c in enumerate(df.columns)]
        flat.append(df.select(*key, "*").toDF(*keys, *[c if c not in keys else f"_twice{i}" for i, c in enumerate(own)]).select(*keys, *[c for c in own if c not in keys], F.lit(side).alias(SIDE)))
        labels.append(list(df.columns))
        places.append(own)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many: the work is by key, so tasks merged by their few bytes would leave cores idle
    both = flat[0].unionByName(flat[1], allowMissingColumns=True).repartition(tasks, *keys)
    both = both.withColumn(first, F.row_number().over(Window.partitionBy(*keys).orderBy(SIDE)) == 1)
    whole = {f.name: f.dataType for f in both.schema if isinstance(f.dataType, _WHOLE) and f.name not in (first, SIDE)}
    missing = {c: F.col(c).isNull() & (F.lit(True) if c in keys else F.col(SIDE) == int(c[2])) for c in whole}
    filled = [F.coalesce(c, F.lit(0).cast(whole[c])).alias(c) if c in whole else F.col(c) for c in both.columns]
    flags, truths = {c: f"_null{c}" for c in whole}, {c for c, t in whole.items() if isinstance(t, BooleanType)}

    def with_nulls(values: pd.Series, null: np.ndarray, truth: bool) -> pd.Series:
        return values.astype(object if truth else "float64").mask(null, None if truth else np.nan)

    def called(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(pdf[first].to_numpy())
        if not len(starts):
            return
        ends = np.append(starts[1:], len(pdf))
        cuts = starts + np.add.reduceat((pdf[SIDE].to_numpy() == 0).astype(np.int64), starts)
        nulls = {c: at for c, flag in flags.items() if (at := pdf[flag].to_numpy().astype(bool)).any()}
        sides = []
        for own, names in zip(places, labels, strict=True):
            rows = pdf[own]
            rows.columns = names
            sides.append((rows, [(i, nulls[c], c in truths) for i, c in enumerate(own) if c in nulls]))
        key_values = [(pdf[c], nulls.get(c), c in truths) for c in keys]

        def part(side: int, a: int, b: int) -> pd.DataFrame:
            rows, doubtful = sides[side]
            rows = rows.iloc[a:b].reset_index(drop=True)
            for i, null, truth in doubtful:
                if null[a:b].any():
                    rows.isetitem(i, with_nulls(rows.iloc[:, i], null[a:b], truth))
            return rows

        tuples, frames = [], {}
        for a, cut, b in zip(starts.tolist(), cuts.tolist(), ends.tolist(), strict=True):
            k = tuple((None if truth else np.float64("nan")) if null is not None and null[a] else values.iat[a] for values, null, truth in key_values)
            got = fn(k, part(0, a, cut), part(1, cut, b))
            if not isinstance(got, pd.DataFrame):
                tuples += got
            elif len(got.columns) or len(got):
                if len(got.columns) != len(outs):
                    raise ValueError(f"{len(got.columns)} columns for the {len(outs)} of the schema")
                frames.setdefault((tuple(got.columns), tuple(got.dtypes)), []).append(got)  # of other types, a frame of its own: none is converted
        for alike in frames.values():
            yield pd.concat(alike, ignore_index=True)
        if tuples:
            yield pd.DataFrame(tuples, columns=outs, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the key that the last batch ended with
        for pdf in batches:
            starts = np.flatnonzero(pdf[first].to_numpy())
            if len(starts):
                yield from called(pd.concat([*held, pdf.iloc[: starts[-1]]], ignore_index=True))
                held, pdf = [], pdf.iloc[starts[-1] :]
            held.append(pdf)
        if held:
            yield from called(pd.concat(held, ignore_index=True))

    return both.select(*filled, *[missing[c].alias(flags[c]) for c in whole]).mapInPandas(run, made)


def interval_join(left: Stream, right: Stream, name: str, on: list[str], lower_ms: int, upper_ms: int, how: str = "inner") -> Stream:
    """Rows of equal key whose right event time lies within [left + lower, left + upper]; both sides need event time, so state has an end."""
    if not (left.event_time and right.event_time):
        raise ValueError("both inputs need event time")
    _together([left, right], name)
    r = right.df.select(*[F.col(c).alias(f"right_{c}") for c in right.df.columns])
    lt, rt = F.col(left.event_time), F.col(f"right_{right.event_time}")
    same: Column = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"right_{c}") for c in on])
    near = (rt >= lt + F.expr(f"INTERVAL {lower_ms / 1000} SECOND")) & (rt <= lt + F.expr(f"INTERVAL {upper_ms / 1000} SECOND"))
    return replace(left, df=left.df.join(r, same & near, how), name=name)


def sides(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Connected rows of a batch, input by input, for stateful processors."""
    for pdf in rows:
        for side, part in pdf.groupby(SIDE, sort=True):
            yield int(side), part
