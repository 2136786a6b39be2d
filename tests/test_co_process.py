"""``co_process`` against a cogroup of Spark's, which it replaces: the same keys and frames, types included."""

import datetime
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventflow.operators import multi
from eventflow.stream import Stream


def _teller():
    """A function that shows all that it can see of its arguments."""

    def told(key, left, right):
        shown = [f"{list(d.columns)} {[str(t) for t in d.dtypes]} {list(d.index)} {sorted(map(repr, d.itertuples(index=False, name=None)))}" for d in (left, right)]
        return pd.DataFrame({"key": [repr([(type(k).__name__, k) for k in key])], "left": [shown[0]], "right": [shown[1]]})

    return told


_SHOWN = "key string, left string, right string"


def _stream(df, name):
    return Stream(df, name)


def _inputs(spark):
    big = 2**60 + 1
    left = spark.createDataFrame(
        [(i % 7 if i % 11 else None, big + i if i % 5 else None, bool(i % 2) if i % 3 else None, f"s{i}" if i % 4 else None, i / 7, datetime.datetime(2024, 1, 1, 0, 0, i % 60), Decimal(i), i) for i in range(200)],
        "k int, n long, b boolean, s string, d double, t timestamp, m decimal(9,2), i int",
    )
    right = spark.createDataFrame([(i % 9 if i % 13 else None, i if i < 60 else None, datetime.date(2024, 1, 1 + i % 28), f"r{i}") for i in range(90)], "k int, n short, day date, s string")
    return left, right


@pytest.mark.parametrize("keys", [["k"], ["k", "s"], ["n"]])
@pytest.mark.parametrize("rows_a_batch", [10_000, 3])
def test_frames_are_those_of_a_cogroup(spark, keys, rows_a_batch):
    left, right = _inputs(spark)
    if keys == ["n"]:
        right = right.withColumn("n", F.col("n").cast("long"))
    want = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_teller(), _SHOWN).collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = multi.co_process(_stream(left, "l"), _stream(right, "r"), "told", keys, _teller(), _SHOWN).df.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got, want = sorted(map(tuple, got)), sorted(map(tuple, want))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w


def test_nested_columns(spark):
    left, right = _inputs(spark)
    left = left.withColumn("u", F.struct("i", "n"))
    want = left.groupBy("k").cogroup(right.groupBy("k")).applyInPandas(_teller(), _SHOWN).collect()
    got = multi.co_process(_stream(left, "l"), _stream(right, "r"), "told", ["k"], _teller(), _SHOWN).df.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    counted = multi.co_process(_stream(left, "l"), _stream(right, "r"), "n", ["k"], lambda k, a, b: [(len(a), len(b))], "l long, r long").df
    assert counted.agg(F.sum("l"), F.sum("r")).first()[:] == (200, 90)


def test_frames_of_different_types_keep_their_values(spark):
    big = 2**60 + 1

    def some(key, left, right):
        k = int(key[0])
        return pd.DataFrame() if k == 0 else pd.DataFrame({"x": [big + k], "y": [float("nan") if k % 2 else k]}) if k % 3 else pd.DataFrame({"y": [k], "x": [None]})

    left, right = spark.range(12).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    want = left.groupBy("k").cogroup(right.groupBy("k")).applyInPandas(some, "x long, y double").collect()
    got = multi.co_process(_stream(left, "l"), _stream(right, "r"), "some", ["k"], some, "x long, y double").df.collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_tuples_and_no_arrow_stream_for_each_key(spark):
    big = 2**60 + 1
    left, right = spark.range(3000).selectExpr("id % 1000 AS k", "id"), spark.range(500, 1500).withColumnRenamed("id", "k")
    out = multi.co_process(_stream(left, "l"), _stream(right, "r"), "n", ["k"], lambda k, a, b: [(k[0], big if len(a) else None, len(b) > 0)] * int(k[0] != 7), "k long, n long, known boolean").df
    assert sorted(map(tuple, out.collect())) == [(k, big if k < 1000 else None, k >= 500) for k in range(1500) if k != 7]
    assert "CoGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_small_tables_use_all_tasks(spark):
    """What a key costs is not told by its bytes: adaptive execution must not merge the tasks by them."""
    left, right = spark.range(3000).withColumnRenamed("id", "k"), spark.range(3000).withColumnRenamed("id", "k")
    key, before = "spark.sql.adaptive.coalescePartitions.parallelismFirst", spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    spark.conf.set(key, "false")
    try:
        out = multi.co_process(_stream(left, "l"), _stream(right, "r"), "n", ["k"], lambda k, a, b: [(k[0],)], "k long").df
        assert out.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set(key, before)


def test_columns_that_do_not_fit_the_schema_are_an_error(spark):
    df = _stream(spark.range(3).withColumnRenamed("id", "k"), "l")
    with pytest.raises(Exception, match="columns"):
        multi.co_process(df, df, "bad", ["k"], lambda k, a, b: pd.DataFrame({"k": [1], "more": [2]}), "k long").df.collect()
