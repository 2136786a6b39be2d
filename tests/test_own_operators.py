"""Operators, watermark generators, lifecycles and options: what a registered query doesn't show."""

import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from eventflow import Environment, Options
from eventflow.environment import Status
from eventflow.functions.windows import Tumbling
from eventflow.operators import multi
from eventflow.operators.basic import filter_
from eventflow.plans.queries import Count
from eventflow.plans.stateful import Diary
from eventflow.sinks import sinks
from eventflow.sources.custom import Source, source_stream
from eventflow.stateful import operators as own
from eventflow.stateful.timers import Timer
from eventflow.stateful.windows import CountTrigger, stateful_window
from tests.test_live import LATE, live, ran


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


def env(spark, tmp_path, **options):
    return Environment(spark, Options(checkpoint_dir=str(tmp_path / "cp"), **options))


def run_of(operator, *generators):
    return own.KeyRun(operator, generators or (own.Bounded,), ("k",), own.Metrics({}), "test")


class Recorded(own.Operator):
    def process(self, ctx, row):
        for kind, at in row.get("timers", ()):
            getattr(ctx.timer_service(), f"register_{kind}_timer")(at, at)
        yield {"row": row["n"], "watermark": ctx.timer_service().current_watermark()}

    def process_right(self, ctx, row):
        yield from self.process(ctx, row)

    def on_event_time(self, ctx, timer):
        yield {"event": timer.payload}

    def on_processing_time(self, ctx, timer):
        yield {"processing": timer.payload, "now": ctx.timer_service().current_processing_time()}

    def on_watermark(self, ctx, watermark):
        yield {"watermark": watermark}

    def on_status(self, ctx, idle):
        yield {"idle": idle}


def test_timers_fire_in_order_before_the_watermark_goes_on():
    run = run_of(Recorded())
    assert list(run.row(1, {"n": 1, "timers": [("event", 9), ("event", 5), ("event", 5), ("event", 99)]}, 3, 0)) == [{"row": 1, "watermark": 0}]
    assert list(run.periodic(0)) == [{"watermark": 2}, {"idle": False}]
    list(run.row(1, {"n": 2}, 20, 0))
    assert list(run.periodic(0)) == [{"event": 5}, {"event": 9}, {"watermark": 19}]
    assert list(run.periodic(0)) == []
    assert list(run.advance(own.END_OF_TIME)) == [{"event": 99}, {"watermark": own.END_OF_TIME}]


def test_processing_timers_fire_at_their_time():
    run = run_of(Recorded())
    list(run.row(1, {"n": 1, "timers": [("processing", 30), ("processing", 20)]}, None, 10))
    assert list(run.clock(15)) == [] and run.next_wake() == 20
    assert list(run.clock(40)) == [{"processing": 20, "now": 20}, {"processing": 30, "now": 30}]
    assert run.next_wake() is None


def test_two_inputs_and_idleness():
    run = run_of(Recorded(), lambda: own.Idle(own.Bounded(0), 100), lambda: own.Idle(own.Bounded(0), 100))
    for side, at, now in ((1, 1000, 0), (2, 100, 0)):
        list(run.row(side, {"n": at}, at, now))
    assert [x for x in run.periodic(0) if "watermark" in x] == [{"watermark": 999}]  # the second is heard of after the first, and never lowers it
    assert run.combined.watermark == 999
    list(run.row(1, {"n": 3}, 2000, 50))
    assert list(run.periodic(50)) == []  # the second input holds back
    assert list(run.periodic(100)) == [{"watermark": 1999}]  # now it is idle
    assert list(run.periodic(150)) == [{"idle": True}]
    again = list(run.row(2, {"n": 4}, 3000, 160))
    assert {"idle": False} in again


def test_state_is_saved_whole():
    class Kept(own.Operator):
        def process(self, ctx, row):
            ctx.state.register_or_get("rows", list).get().append(row["n"])
            ctx.timer_service("mine").register_event_timer("x", 50)
            ctx.exec(lambda: ctx.state.register_or_get("jobs", list).get().append("ran"))

        def on_checkpoint(self, ctx):
            ctx.state.register_or_get("checkpoints", list).get().append(len(ctx.state.names()))

    first = run_of(Kept())
    list(first.row(1, {"n": 7}, 10, 0))
    second = own.KeyRun(Kept(), (own.Bounded,), ("k",), own.Metrics({}), "test", first.save())
    assert second.values == {"rows": [7], "jobs": ["ran"], "checkpoints": [2]} or second.values["rows"] == [7]
    assert second.services["mine"].event.peek() == Timer("x", 50)
    cell = second.ctx.state.register_or_get("rows", list)
    cell.set([1])
    assert cell.get() == [1] and "rows" in second.ctx.state
    cell.clear()
    assert "rows" not in second.ctx.state
    second.ctx.state.clear()
    assert second.ctx.state.names() == []


def test_operators_need_their_parts(spark, tmp_path):
    e = env(spark, tmp_path)
    s = e.from_source("s", spark.createDataFrame([(1, 1000)], "k int, ms long")).assign_timestamps("t", "ms")
    for bad in ({"operator": None}, {"keys": []}, {"emit_every_ms": -1}):
        with pytest.raises(ValueError):
            own.process(s, str(bad), **({"keys": ["k"], "operator": own.Operator(), "schema": "n int"} | bad))
    with pytest.raises(Exception, match="define process"):
        own.process(s, "none", ["k"], own.Operator(), "n int").df.collect()
    with pytest.raises(ValueError):
        own.Idle(own.Bounded(), -1)
    with pytest.raises(ValueError):
        own.Idle(None, 1)


class Wait(own.Operator):
    """Every row, and again half a second of the clock later."""

    def process(self, ctx, row):
        ctx.metrics.count("rows")
        ctx.timer_service().register_processing_timer(row["ms"], ctx.timer_service().current_processing_time() + 500)
        seen = ctx.state.register_or_get("seen", int)
        seen.set(seen.get() + 1)
        yield {"k": ctx.key[0], "ms": row["ms"], "seen": seen.get(), "again": False}

    def on_processing_time(self, ctx, timer):
        yield {"k": ctx.key[0], "ms": timer.payload, "seen": ctx.state.register_or_get("seen", int).get(), "again": True}


def test_unbounded_operator(spark, tmp_path):
    stream = live(spark, tmp_path, [[(1, "a"), (2, "b")], [(3, "a")]]).map("both", "event_ts", "k", "ms")
    rows = spark.sparkContext.accumulator(0)
    out, got = own.process(stream, "wait", ["k"], Wait(), "k string, ms long, seen long, again boolean", order=["ms"], counters={"rows": rows}), []
    sinks.to_callbacks(out, "sink", lambda df, n: got.extend(tuple(r) for r in df.collect()), lambda ms: None, once=False)
    out.environment.start()
    until = time.time() + 90
    while len(got) < 6 and time.time() < until:
        time.sleep(0.2)
    out.environment.stop()
    assert sorted((k, ms) for k, ms, _, again in got if not again) == sorted((k, ms) for k, ms, _, again in got if again) == [("a", 1), ("a", 3), ("b", 2)]
    assert max(seen for k, _, seen, _ in got if k == "a") == 2 and rows.value == 3
    assert out.environment.status is Status.CLOSED


def test_late_rows_are_counted_and_cleared_windows_told(spark, tmp_path):
    class Process:
        def __call__(self, key, start, end, r):
            return [{"start": start, "n": r[0]}]

        def clear(self, key, start, end):
            cleared.add(1)

    cleared, late = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    rows = live(spark, tmp_path, LATE).map("one", "event_ts", "k", F.lit(1).alias("cents"))
    out = rows.apply("w", lambda df: stateful_window(df, Tumbling(60_000), "event_ts", ["k"], ["cents"], Count(), "start long, n long", process=Process(), late_rows=late, state="n long, cents long", on_late=lambda key, s, e, row: [{"start": s, "n": -1}]))
    got = [r for r in ran(out) if isinstance(r, tuple)]
    assert sorted(got) == sorted([("a", 0, 2, 59_999), ("b", 0, 1, 59_999), ("c", 60_000, 2, 119_999), ("a", 0, -1, 59_999), ("a", 0, -1, 59_999)])
    assert late.value == 2 and cleared.value == 3


def test_count_trigger_with_typed_state(spark, tmp_path):
    rows = live(spark, tmp_path, [[(i * 1000, "a") for i in range(5)], [(100_000, "z")], [(300_000, "z")]]).map("one", "event_ts", "k", F.lit(1).alias("cents"))
    out = rows.apply("w", lambda df: stateful_window(df, Tumbling(60_000), "event_ts", ["k"], ["cents"], Count(), "n long", trigger=CountTrigger(2, purge=True), process=lambda key, s, e, r: [{"n": r[0]}], state="n long, cents long"))
    assert [r[1] for r in ran(out) if isinstance(r, tuple) and r[0] == "a"] == [2, 2, 1]


class Failing(Diary):
    def __init__(self, times):
        super().__init__()
        self.times = times

    def batch(self, df, number):
        if self.times:
            self.times -= 1
            raise RuntimeError("not yet")
        super().batch(df, number)


@pytest.mark.parametrize("times, ends", [(1, True), (3, False)])
def test_tolerable_failures(spark, tmp_path, times, ends):
    stream = live(spark, tmp_path, [[(1, "a")]])
    e = stream.environment
    object.__setattr__(e.options, "tolerable_failures", 2)
    diary = Failing(times)
    sinks.to_sink(stream, "sink", diary)
    if ends:
        e.start(supervised=True).wait()
    else:
        with pytest.raises(Exception, match="not yet"):
            e.start(supervised=True).wait()
    told = [what for what, _ in diary.lines]
    assert told.count("cancelled") == min(times, 3) and told[0] == "open" and told[-1] == "close" and told.count("open") == 1
    assert e.failures == min(times, 3) and ("complete" in told) == ends


def test_checkpoints_wait_for_their_turn(spark, tmp_path):
    e = env(spark, tmp_path, max_concurrent=1, checkpoint_timeout=50)
    with e.commit_slot(), pytest.raises(TimeoutError, match="declined"), e.commit_slot():
        pass
    with e.commit_slot():
        pass


def test_bounded_sink_hears_all(spark, tmp_path):
    e, diary = env(spark, tmp_path), Diary()
    sinks.to_sink(e.from_source("s", spark.range(3)), "sink", diary)
    e.start().wait()
    assert diary.lines == [("open", 0), ("comes", 0), ("batch", 0), ("watermark", (1 << 63) - 1), ("complete", 0), ("close", 0)]
    with pytest.raises(RuntimeError):
        e.start()
    with pytest.raises(ValueError):
        sinks.to_sink(e.from_source("t", spark.range(3)), "none", object())


def test_source_is_opened_and_closed(spark, tmp_path):
    told = tmp_path / "told"
    told.mkdir()

    class Numbers(Source):
        def _say(self, what):
            (told / f"{what}-{time.time_ns()}").touch()

        def open(self):
            self._say("open")

        def latest(self, start):
            return min(start + 5, 10)

        def replay(self, start, end):
            return [(n,) for n in range(start, end)]

        def committed(self, offset):
            self._say(f"committed{offset}")

        def close(self):
            self._say("close")

    e, got = env(spark, tmp_path), []
    stream = e.from_source("n", source_stream(spark, "own_numbers", Numbers, "n long", parts=2))
    sinks.to_callbacks(stream, "sink", lambda df, n: got.extend(r.n for r in df.collect()), lambda ms: None, once=False)
    e.start()
    until = time.time() + 60
    while len(got) < 10 and time.time() < until:
        time.sleep(0.1)
    time.sleep(1)
    e.stop()
    names = [p.name.split("-")[0] for p in told.iterdir()]
    assert sorted(got) == list(range(10)) and "committed5" in names
    assert names.count("open") - 1 <= names.count("close") <= names.count("open") and names.count("close") >= 4  # Spark may end the driver's reader by itself


class Hooks:
    def __init__(self, path):
        self.path = path

    def open(self):
        (self.path / f"open-{time.time_ns()}").touch()

    def close(self):
        (self.path / f"close-{time.time_ns()}").touch()


def test_hooks_run_around_column_expressions(spark, tmp_path):
    e = env(spark, tmp_path)
    s = e.from_source("s", spark.range(4, numPartitions=2))
    for name, make in {
        "m": lambda h: s.map("m", (F.col("id") + 1).alias("id"), rich=h),
        "f": lambda h: s.filter("f", F.col("id") == 1, rich=h),
        "x": lambda h: s.flat_map("x", F.array("id"), "v", rich=h),
        "u": lambda h: multi.union([s, s], "u", rich=h),
    }.items():
        folder = tmp_path / name
        folder.mkdir()
        make(Hooks(folder)).df.collect()
        kinds = [p.name.split("-")[0] for p in folder.iterdir()]
        assert kinds.count("open") == kinds.count("close") >= 2


def test_dropping_comparisons_reach_the_scan(spark, tmp_path, sf):
    from eventflow.sources import files

    e = env(spark, tmp_path)
    events = e.from_source("e", files.table(spark, sf, "events"))
    plan = events.filter("late", F.col("user_id") > 3).map("m", "event_id").df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(user_id),LessThanOrEqual(user_id,3))]" in plan
    odd = spark.createDataFrame([(1, 2), (None, 2), (3, None), (3, 1)], "a int, b int")
    for p in (F.col("a") > F.col("b"), F.col("a") == 1, (F.col("a") > 1) & (F.col("b") > 0), F.col("a").isNull(), F.coalesce("a", F.lit(0)) > 1):
        want = odd.where(~F.coalesce(p, F.lit(False))).collect()
        assert sorted(map(str, filter_(env(spark, tmp_path).from_source("o", odd), "f", p).df.collect())) == sorted(map(str, want))


def test_metrics_and_logs_are_streams(spark, tmp_path):
    from eventflow.environment import log

    e = env(spark, tmp_path, metrics_interval=50)
    assert e.metrics_stream() is e.metrics_stream() and e.log_stream() is e.log_stream()
    assert e.metrics_stream().df.isStreaming and e.graph["metrics"] == [] and e.graph["log"] == []
    e.metrics.report(("counter", "x", {"a": "b"}, 5, None, None, None, None, None))
    log.warning("seen", extra={"n": 5})
    until = time.time() + 20
    while not (any("json" in str(p) for p in (tmp_path / "cp").rglob("0*.json"))) and time.time() < until:
        time.sleep(0.1)
    assert [(r.name, r.value_long, r.tags) for r in e.metrics.rows().collect()] == [("x", 5, {"a": "b"})]
    assert [r.message for r in e.logs.rows().collect()] == ["seen"]
    e.metrics.close()
    e.logs.detach()
