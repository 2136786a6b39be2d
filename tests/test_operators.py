import pytest
from pyspark.sql import functions as F

from eventflow import Environment, Options
from eventflow.functions.windows import event_time
from eventflow.operators import basic, multi
from eventflow.sinks import sinks
from eventflow.stream import DifferentEnvironments


@pytest.fixture
def env(spark, tmp_path):
    return Environment(spark, Options(checkpoint_dir=str(tmp_path)))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_filter_drops_true_and_passes_null(env, spark):
    s = env.from_source("s", spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, p boolean"))
    assert rows(s.filter("f", F.col("p")).df.select("id")) == [(2,), (3,)]
    assert rows(s.keep("k", F.col("p")).df.select("id")) == [(1,)]


def test_functions_are_needed(env, spark):
    s = env.from_source("s", spark.range(3))
    for op in (basic.map_, basic.filter_, basic.flat_map):
        with pytest.raises(ValueError):
            op(s, op.__name__)


def test_rich_opens_and_closes(env, spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()

    class Marks:
        def open(self):
            (marks / "open").touch()

        def close(self):
            (marks / "close").touch()

    s = env.from_source("s", spark.range(10, numPartitions=2))
    out = basic.map_(s, "m", fn=lambda pdf: pdf, schema="id long", rich=Marks())
    assert out.df.count() == 10
    assert {p.name for p in marks.iterdir()} == {"open", "close"}


def test_flat_map_inherits_event_time(env, spark):
    s = env.from_source("s", spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "ms long, w array<string>")).assign_timestamps("t", "ms")
    out = s.flat_map("f", F.col("w"), "word")
    assert out.event_time == "event_ts"
    assert rows(out.df.select("ms", "word")) == [(1, "a"), (1, "b")]


def test_union_checks(env, spark, tmp_path):
    a, b = (env.from_source(n, spark.range(2)) for n in "ab")
    with pytest.raises(ValueError):
        multi.union([a], "one")
    other = Environment(spark, Options(checkpoint_dir=str(tmp_path))).from_source("a", spark.range(1))
    with pytest.raises(DifferentEnvironments):
        multi.union([a, other], "mixed")
    with pytest.raises(TypeError):
        multi.union([a, env.from_source("c", spark.range(1).select(F.col("id").cast("string")))], "types")
    u = multi.union([a, b, a], "ok")
    assert u.name == "operator.ok" and u.df.count() == 6


def test_names_are_unique(env, spark):
    s = env.from_source("s", spark.range(1))
    s.map("m", "id")
    with pytest.raises(ValueError):
        s.map("m", "id")


def test_window_needs_its_parts(env, spark):
    s = env.from_source("s", spark.createDataFrame([(0, "k")], "ms long, k string")).assign_timestamps("t", "ms")
    count = [F.count(F.lit(1)).alias("n")]
    for bad in ({"keys": ["k"]}, {"aggregates": count}, {"aggregates": count, "keys": ["k"], "global_key": True}):
        with pytest.raises(ValueError):
            s.window("w", event_time(10), **bad)


def test_graph_is_checked(env, spark):
    with pytest.raises(ValueError):
        env.start()
    s = env.from_source("s", spark.range(1))
    s.map("loose", "id")
    got = []
    sinks.to_callbacks(s, "sink", lambda df, n: got.append((n, df.count())), got.append)
    with pytest.raises(ValueError):
        env.start()


def test_bounded_sink(env, spark):
    got = []
    sinks.to_callbacks(env.from_source("s", spark.range(5)), "sink", lambda df, n: got.append((n, df.count())), got.append)
    env.start()
    assert got == [(0, 5), (1 << 63) - 1] and env.done
    with pytest.raises(ValueError):
        sinks.to_callbacks(env.from_source("t", spark.range(5)), "none", None, None)


def test_options():
    for bad in ({"buffer_size": 0}, {"periodic_checkpoint": -1}, {"name": ""}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert Options(periodic_checkpoint=5000, min_pause=60_000).trigger_ms == 60_000


def test_interval_join(env, spark):
    a = env.from_source("a", spark.createDataFrame([(1, 1000), (1, 9000)], "k int, ms long")).assign_timestamps("ta", "ms")
    b = env.from_source("b", spark.createDataFrame([(1, 1500), (2, 1500)], "k int, ms long")).assign_timestamps("tb", "ms")
    out = multi.interval_join(a, b, "j", ["k"], 0, 1000)
    assert [(r.ms, r.right_ms) for r in out.df.collect()] == [(1000, 1500)]


def test_plans_push_down(env, spark, sf):
    from eventflow.sources import files

    df = env.from_source("e", files.table(spark, sf, "events")).keep("k", F.col("user_id") == 3).map("m", "event_id").df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_log_stream_before_reading(env):
    from eventflow.environment import log

    logs = env.logs
    log.error("one", extra={"n": 5})
    row = logs.rows().collect()[0]
    assert row.level == 2 and row.message == "one" and row.fields[0].integer == 5
    logs.detach()
