"""Queries of what keeps state: operators of one's own, timers, watermarks by key, lateness, triggers, sinks and sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.environment import Environment, Options
from eventflow.functions.windows import Tumbling, event_time, processing_time
from eventflow.operators.basic import filter_, flat_map, map_
from eventflow.operators.multi import union
from eventflow.plans.queries import HOUR, MINUTE, Count, _environment, _events, _folder, _live, _ran, _window
from eventflow.sinks import sinks
from eventflow.sources import files
from eventflow.sources.custom import Source, source_stream
from eventflow.stateful import operators as own
from eventflow.stateful.windows import Trigger, TriggerResult, stateful_window

DAY = 24 * HOUR
_IN_ORDER = (own.AT, "event_id")


def _rows(spark: SparkSession, sf_dir: str):
    return _events(spark, sf_dir, nearest=False).map("rows", "event_ts", "user_id", "event_id", "event_type")


class Reminders(own.Operator):
    """A timer a day after each purchase; a click takes away the timers that wait."""

    def process(self, ctx, row):
        timers, waiting = ctx.timer_service("reminders"), ctx.state.register_or_get("waiting", dict)
        last = ctx.state.register_or_get("last", lambda: None)
        if row["event_type"] == "click":
            for event, at in waiting.get().items():
                timers.delete_event_timer(event, at)
            waiting.set({})
        if row["event_type"] == "purchase":
            at = row["ms"] + DAY
            timers.register_event_timer(row["event_id"], at)
            waiting.get()[row["event_id"]] = at
        last.set(row["event_id"])

    def on_event_time(self, ctx, timer):
        ctx.state.register_or_get("waiting", dict).get().pop(timer.payload, None)
        yield {"user_id": ctx.key[0], "event_id": timer.payload, "fires_at": timer.timestamp}


def operator_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers in event time, set, deleted and fired by a watermark that follows the rows; the last ones fire at the end of input."""
    timed = _rows(spark, sf_dir).map("ms", "*", F.unix_millis("event_ts").alias("ms"))
    return own.process(timed, "reminders", ["user_id"], Reminders(), "user_id long, event_id long, fires_at long", order=_IN_ORDER).df


class Nth(own.Operator):
    """The first three rows of each type, by a map in the key's state."""

    def process(self, ctx, row):
        seen = ctx.state.register_or_get("seen", dict).get()
        nth = seen[row["event_type"]] = seen.get(row["event_type"], 0) + 1
        if nth <= 3:
            yield {"user_id": ctx.key[0], "event_id": row["event_id"], "nth": nth}


def operator_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own.process(_rows(spark, sf_dir), "nth", ["user_id"], Nth(), "user_id long, event_id long, nth long", order=_IN_ORDER).df


class Snooze(own.Operator):
    """A timer in processing time an hour after each row."""

    def process(self, ctx, row):
        timers = ctx.timer_service()
        timers.register_processing_timer(row["event_id"], timers.current_processing_time() + HOUR)

    def on_processing_time(self, ctx, timer):
        yield {"user_id": ctx.key[0], "event_id": timer.payload, "fires_at": timer.timestamp, "now": ctx.timer_service().current_processing_time()}


def processing_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers of the processing clock, which here is the rows' own time."""
    return own.process(_rows(spark, sf_dir), "snooze", ["user_id"], Snooze(), "user_id long, event_id long, fires_at long, now long", order=_IN_ORDER).df


class Told(own.Operator):
    """Every row with the watermark that its key has when it comes."""

    def process(self, ctx, row):
        yield {"user_id": ctx.key[0], "event_id": row["event_id"], "watermark": ctx.timer_service().current_watermark()}

    process_right = process


_TOLD = "user_id long, event_id long, watermark long"


def _two(spark: SparkSession, sf_dir: str):
    rows = _rows(spark, sf_dir)
    return rows.keep("clicks", F.col("event_type") == "click"), rows.filter("others", F.col("event_type") == "click")


def two_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs with a watermark each: the lesser counts, but for an input that has not been heard of."""
    left, right = _two(spark, sf_dir)
    return own.process_two(left, right, "told", ["user_id"], Told(), _TOLD, order=_IN_ORDER).df


def idle_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with inputs that fall idle after six hours and then hold the other back no more."""
    left, right = _two(spark, sf_dir)
    return own.process_two(left, right, "told", ["user_id"], Told(), _TOLD, generators=(_idle, _idle), order=_IN_ORDER).df


def _idle() -> own.Generator:
    return own.Idle(own.Bounded(0), 6 * HOUR)


class Punctuated(own.Generator):
    """A purchase says that all before it has come."""

    def on_event(self, row, timestamp, out):
        if row["event_type"] == "purchase":
            out.emit(timestamp - 1)


def custom_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own.process(_rows(spark, sf_dir), "told", ["user_id"], Told(), _TOLD, generator=Punctuated, order=_IN_ORDER).df


def watermark_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks every twelve hours of the clock only."""
    return own.process(_rows(spark, sf_dir), "told", ["user_id"], Told(), _TOLD, order=_IN_ORDER, emit_every_ms=12 * HOUR).df


def no_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without watermarks event-time timers wait for the end of input, and fire all then."""
    timed = _rows(spark, sf_dir).filter("no_clicks", F.col("event_type") == "click").map("ms", "*", F.unix_millis("event_ts").alias("ms"))
    return own.process(timed, "reminders", ["user_id"], Reminders(), "user_id long, event_id long, fires_at long", generator=own.Never, order=_IN_ORDER).df


class Statuses(own.Operator):
    """How often a key's inputs all fell idle, told with each row, and how many rows it has had, by a job after each."""

    def process(self, ctx, row):
        count = ctx.state.register_or_get("rows", int)
        ctx.exec(lambda: count.set(count.get() + 1))
        yield {"user_id": ctx.key[0], "event_id": row["event_id"], "idle_times": ctx.state.register_or_get("idle", int).get(), "rows_before": count.get()}

    def on_status(self, ctx, idle):
        times = ctx.state.register_or_get("idle", int)
        times.set(times.get() + idle)


def operator_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input asked every hour whether it has fallen idle (after six)."""
    return own.process(_rows(spark, sf_dir), "statuses", ["user_id"], Statuses(), "user_id long, event_id long, idle_times long, rows_before long", generator=_idle, order=_IN_ORDER, emit_every_ms=HOUR).df


class Offset:
    """Opened before a partition's first row, closed after its last."""

    value = 0

    def open(self):
        self.value = 100

    def close(self):
        self.value = 0


def rich_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks around map, filter, flat_map and union."""
    offset = Offset()
    events = _events(spark, sf_dir)
    shifted = map_(events, "shift", fn=lambda pdf: (pdf[["event_id"]] + offset.value).assign(user_id=pdf["user_id"]), schema="event_id long, user_id long", rich=offset)
    kept = filter_(shifted, "few", fn=lambda pdf: pdf["user_id"] > offset.value / 10, rich=offset)
    twice = flat_map(kept, "twice", F.array(F.lit(1), F.lit(2)), "k", rich=Offset())
    return union([twice, filter_(twice, "ones", F.col("k") == 1, rich=Offset())], "both", rich=Offset()).df


# Lateness, triggers, processing time


def _arrival() -> str:
    return "(event_id + event_id * 7919 % 400)"


def _shuffled(spark: SparkSession, sf_dir: str, batches: int = 12) -> DataFrame:
    """Events in an order of arrival that is out of order, as a stream of one file per batch."""
    folder = _folder(spark)
    events = files.table(spark, sf_dir, "events").withColumn("arrival", F.expr(_arrival()))
    last = events.agg(F.max("arrival")).first()[0]
    numbered = events.withColumn("batch", F.floor(F.col("arrival") * batches / F.lit(last + 1)))
    for b in range(batches):  # a table of the test, not data that grows: files must come one after the other
        numbered.where(F.col("batch") == b).drop("arrival", "batch").coalesce(1).write.parquet(f"{folder}/{b:03d}")
    return files.read_stream(spark, f"{folder}/*", files.table(spark, sf_dir, "events").schema, files_per_batch=1)


def stream_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours on rows out of order: results on time, one more for each row within the lateness, and rows that come later still."""
    source = _environment(spark).from_source("events", _shuffled(spark, sf_dir))
    live = source.assign_timestamps("timed", "ts", out_of_orderness_ms=2 * HOUR, lateness_ms=12 * HOUR).map("few", "event_ts", "event_type", F.lit(0).alias("cents"))

    def windows(df: DataFrame) -> DataFrame:
        return stateful_window(
            df, Tumbling(6 * HOUR), "event_ts", ["event_type"], ["cents"], Count(), "window_start long, n long", 12 * HOUR, process=lambda key, s, e, r: [{"window_start": s, "n": r[0]}],
            state="n long, cents long", on_late=lambda key, s, e, row: [{"window_start": s, "n": -1}],
        )

    out = _ran(spark, live.apply("late", windows), "update")
    return out.groupBy("event_type", "window_start").agg(F.count(F.when(F.col("n") > 0, 1)).alias("results"), F.coalesce(F.max(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("most"), F.count(F.when(F.col("n") < 0, 1)).alias("dropped"))


class Halfway(Trigger):
    """A result half way through a window too, by a timer of the trigger's own, once: it remembers having set it."""

    def on_row(self, ctx, row, count, start, end):
        if not ctx.state.get("set"):
            ctx.state["set"] = True
            ctx.register_timer((start + end) // 2)
            ctx.register_timer(start + 1)
            ctx.delete_timer(start + 1)
        return super().on_row(ctx, row, count, start, end)

    def on_event_timer(self, ctx, at, start, end):
        return TriggerResult.FIRE


def stream_trigger_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark, sf_dir, nearest=False).map("few", "event_ts", "event_type", F.lit(0).alias("cents"))
    out = live.apply("half", lambda df: stateful_window(df, Tumbling(DAY), "event_ts", ["event_type"], ["cents"], Count(), "n long", trigger=Halfway(), process=lambda key, s, e, r: [{"n": r[0]}]))
    return _ran(spark, out, "update").groupBy("event_type", "event_ms").agg(F.count(F.lit(1)).alias("results"), F.max("n").alias("n"))


def stream_processing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the wall clock on an unbounded stream: when a row falls is chance, but each is in one window."""
    import time

    env = _environment(spark)
    rows = env.from_source("events", files.replay(spark, sf_dir, "events")).map("few", "event_type", F.lit(0).alias("cents"))
    out = rows.apply("clock", lambda df: stateful_window(df, processing_time(200), None, ["event_type"], ["cents"], Count(), "n long", process=lambda key, s, e, r: [{"n": r[0]}]))
    wanted, seen, where = files.table(spark, sf_dir, "events").count(), [], _folder(spark)

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{where}/batch={number}")
        seen.append(spark.read.parquet(f"{where}/batch={number}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    sinks.to_callbacks(out, "sink", keep, lambda ms: None, "update", once=False)
    env.start()
    until = time.monotonic() + 120
    while sum(seen) < wanted and time.monotonic() < until and not env.done:
        time.sleep(0.1)
    env.stop()
    return spark.read.schema(out.df.schema).option("recursiveFileLookup", "true").parquet(where).groupBy("event_type").agg(F.sum("n").alias("n"), (F.count(F.when(F.col("event_ms") % 200 != 199, 1))).alias("uneven"))


# Sinks, sources, restarts


class Diary(sinks.Sink):
    """Writes down what a sink is told."""

    def __init__(self):
        self.lines: list[tuple[str, int]] = []

    def open(self):
        self.lines.append(("open", 0))

    def batch(self, df, number):
        df.write.format("noop").mode("overwrite").save()
        self.lines.append(("batch", number))

    def watermark(self, ms):
        self.lines.append(("watermark", ms))

    def checkpoint_comes(self, number):
        self.lines.append(("comes", number))

    def checkpoint_complete(self, number):
        self.lines.append(("complete", number))

    def checkpoint_cancelled(self, number):
        self.lines.append(("cancelled", number))

    def close(self):
        self.lines.append(("close", 0))


def sink_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sink of one's own is told, in order: checkpoints, batches, the last watermark, the end."""
    diary = Diary()
    counted = _live(spark, sf_dir, nearest=False).window("hourly", event_time(HOUR), aggregates=[F.count(F.lit(1)).alias("n")], keys=["event_type"])
    sinks.to_sink(counted, "diary", diary)
    counted.environment.start().wait()
    return spark.createDataFrame([(i, what, n) for i, (what, n) in enumerate(diary.lines)], "position long, what string, value long")


class Squares(Source):
    def latest(self, start):
        return 100

    def replay(self, start, end):
        return ((n, n * n) for n in range(start, end))


def source_of_ones_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of one's own, read by three tasks."""
    stream = _environment(spark).from_source("squares", source_stream(spark, "squares", Squares, "n long, square long", parts=3))
    return _ran(spark, stream)


def supervised_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that fails twice, under an environment that tolerates it: every row arrives once."""
    env = Environment(spark, Options(name="supervised", checkpoint_dir=_folder(spark), tolerable_failures=2, max_concurrent=1))
    stream, where, tries = env.from_source("events", files.replay(spark, sf_dir, "events")).map("few", "event_id", "event_type"), _folder(spark), []

    def keep(df: DataFrame, number: int) -> None:
        tries.append(number)
        if len(tries) <= 2:
            raise RuntimeError("not yet")
        df.write.mode("overwrite").parquet(f"{where}/batch={number}")

    sinks.to_callbacks(stream, "sink", keep, lambda ms: None)
    env.start(supervised=True).wait()
    rows = spark.read.schema(stream.df.schema).option("recursiveFileLookup", "true").parquet(where)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("different")).withColumn("failures", F.lit(env.failures))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            operator_timers, operator_state, processing_timers, two_watermarks, idle_inputs, custom_generator, watermark_interval, no_watermarks, operator_status, rich_operators,
            stream_lateness, stream_trigger_timers, stream_processing_time, sink_lifecycle, source_of_ones_own, supervised_restart,
        )
    }


#: Milliseconds as Spark has them: cut off, where ``epoch_ms`` rounds.
_E = """e AS (SELECT user_id, event_id, event_type, t, row_number() OVER w AS i, lag(t) OVER w AS before,
  max(CASE WHEN event_type = 'click' THEN t END) OVER w AS l, max(CASE WHEN event_type <> 'click' THEN t END) OVER w AS r, first_value(t) OVER w AS t0
  FROM (SELECT *, (epoch_us(ts) // 1000) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""
_BEFORE = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LAST = f"(SELECT (epoch_us(max(ts)) // 1000) FROM events) - {10 * MINUTE}"
_SIX, _OOO, _LATE = 6 * HOUR, 2 * HOUR, 12 * HOUR
ORACLES = {
    "operator_timers": f"WITH {_E} SELECT user_id, event_id, t + {DAY} AS fires_at FROM e p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM e r WHERE r.user_id = p.user_id AND r.i > p.i AND r.event_type = 'click' AND r.before <= p.t + {DAY})",
    "operator_state": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (epoch_us(ts) // 1000), event_id) AS nth FROM events QUALIFY nth <= 3",
    "processing_timers": f"SELECT user_id, event_id, (epoch_us(ts) // 1000) + {HOUR} AS fires_at, (epoch_us(ts) // 1000) + {HOUR} AS now FROM events QUALIFY max((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id) >= (epoch_us(ts) // 1000) + {HOUR}",
    "two_watermarks": f"WITH {_E} SELECT user_id, event_id, coalesce(max(CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l ELSE least(l, r) END - 1) {_BEFORE}, 0) AS watermark FROM e",
    "idle_inputs": f"WITH {_E} SELECT user_id, event_id, coalesce(max(CASE WHEN l IS NULL OR t - l >= {_SIX} THEN r WHEN r IS NULL OR t - r >= {_SIX} THEN l ELSE least(l, r) END - 1) {_BEFORE}, 0) AS watermark FROM e",
    "custom_generator": f"WITH {_E} SELECT user_id, event_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN t - 1 END) {_BEFORE}, 0) AS watermark FROM e",
    "watermark_interval": f"WITH {_E} SELECT user_id, event_id, coalesce(max(CASE WHEN (t - t0) // {12 * HOUR} > (before - t0) // {12 * HOUR} THEN before - 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id), 0) AS watermark FROM e",
    "no_watermarks": f"SELECT user_id, event_id, (epoch_us(ts) // 1000) + {DAY} AS fires_at FROM events WHERE event_type = 'purchase'",
    "operator_status": f"WITH {_E} SELECT user_id, event_id, CAST(count(CASE WHEN (t - t0) // {HOUR} - (before - t0) // {HOUR} > 6 THEN 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS idle_times, i - 1 AS rows_before FROM e",
    "rich_operators": "SELECT event_id, user_id, k FROM (SELECT event_id + 100 AS event_id, user_id, unnest([1, 2, 2]) AS k FROM events WHERE user_id <= 10)",
    "stream_lateness": f"""WITH e AS (SELECT event_type, (epoch_us(ts) // 1000) AS t, {_window('(epoch_us(ts) // 1000)', _SIX)} AS window_start, {_arrival()} AS arrival FROM events),
b AS (SELECT *, arrival * 12 // ((SELECT max(arrival) FROM e) + 1) AS batch FROM e),
w AS (SELECT batch, lag(high) OVER (ORDER BY batch) - {_OOO} AS mark FROM (SELECT batch, max(max(t)) OVER (ORDER BY batch) AS high FROM b GROUP BY batch)),
r AS (SELECT event_type, window_start, window_start + {_SIX} AS ends, coalesce(mark, 0) AS mark FROM b JOIN w USING (batch)),
c AS (SELECT event_type, window_start, count(CASE WHEN ends > mark THEN 1 END) AS in_time, count(CASE WHEN ends <= mark AND ends + {_LATE} > mark THEN 1 END) AS late, count(CASE WHEN ends + {_LATE} <= mark THEN 1 END) AS dropped,
      max(ends) <= (SELECT (epoch_us(max(ts)) // 1000) FROM events) - {_OOO} AS closed FROM r GROUP BY 1, 2)
SELECT event_type, window_start, late + CAST(in_time > 0 AND closed AS BIGINT) AS results, CASE WHEN late > 0 OR in_time > 0 AND closed THEN in_time + late ELSE 0 END AS most, dropped FROM c WHERE late > 0 OR in_time > 0 AND closed OR dropped > 0""",
    "stream_trigger_timers": f"SELECT event_type, s + {DAY - 1} AS event_ms, CAST(s + {DAY // 2} <= {_LAST} AS BIGINT) + CAST(s + {DAY} <= {_LAST} AS BIGINT) AS results, n FROM (SELECT event_type, {_window('(epoch_us(ts) // 1000)', DAY)} AS s, count(*) AS n FROM events GROUP BY 1, 2) WHERE s + {DAY // 2} <= {_LAST}",
    "stream_processing_time": "SELECT event_type, count(*) AS n, CAST(0 AS BIGINT) AS uneven FROM events GROUP BY 1",
    "sink_lifecycle": f"SELECT CAST(p AS BIGINT) AS position, what, CAST(value AS BIGINT) AS value FROM (VALUES (0, 'open', 0), (1, 'comes', 0), (2, 'batch', 0), (3, 'complete', 0), (4, 'comes', 1), (5, 'batch', 1), (6, 'complete', 1), (8, 'close', 0)) AS v(p, what, value) UNION ALL SELECT 7, 'watermark', {_LAST}",
    "source_of_ones_own": "SELECT range AS n, range * range AS square FROM range(100)",
    "supervised_restart": "SELECT event_type, count(*) AS n, count(*) AS different, 2 AS failures FROM events GROUP BY 1",
}
