"""Unbounded input: one file per batch, so that results per batch are known."""

import json

import pytest
from pyspark.sql import functions as F

from eventflow import Environment, Options
from eventflow.functions.windows import Tumbling, event_time
from eventflow.plans.queries import Count
from eventflow.sinks import sinks
from eventflow.sources import files, mock
from eventflow.sources.custom import source_stream
from eventflow.stateful.windows import CountTrigger, TriggerResult, connect_stream, stateful_window


def put(folder, batches):
    folder.mkdir(exist_ok=True)
    have = len(list(folder.iterdir()))
    for i, batch in enumerate(batches, have):
        path = folder / f"{i:04d}.json"
        path.write_text("\n".join(json.dumps({"ms": ms, "k": k}) for ms, k in batch))
        import os

        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def live(spark, tmp_path, batches, **times):
    put(tmp_path / "in", batches)
    env = Environment(spark, Options(checkpoint_dir=str(tmp_path / "cp")))
    raw = files.read_stream(spark, str(tmp_path / "in"), "ms long, k string", "json", files_per_batch=1)
    return env.from_source("s", raw).assign_timestamps("t", "ms", **times)


def ran(stream, mode="update"):
    out = []
    sinks.to_callbacks(stream, "sink", lambda df, n: out.extend(sorted(tuple(r) for r in df.collect())), lambda ms: out.append(ms), mode)
    env = stream.environment.start()
    for q in env.queries:
        q.awaitTermination()
    env.stop()
    return out


def windows(stream, lateness=0, trigger=None):
    rows = stream.map("one", "event_ts", "k", F.lit(1).alias("cents"))
    return rows.apply("w", lambda df: stateful_window(df, Tumbling(60_000), "event_ts", ["k"], ["cents"], Count(), "start long, n long", lateness, trigger, lambda key, s, e, r: [{"start": s, "n": r[0]}]))


LATE = [[(10_000, "a"), (12_000, "b")], [(45_000, "a")], [(65_000, "c")], [(20_000, "a")], [(95_000, "c")], [(30_000, "a")], [(200_000, "c")]]


def test_lateness(spark, tmp_path):
    out = [r for r in ran(windows(live(spark, tmp_path, LATE, lateness_ms=30_000), 30_000)) if isinstance(r, tuple)]
    assert sorted(out) == sorted([("a", 0, 2, 59_999), ("b", 0, 1, 59_999), ("a", 0, 3, 59_999), ("c", 60_000, 2, 119_999)])
    assert out.index(("a", 0, 2, 59_999)) < out.index(("a", 0, 3, 59_999))


def test_no_lateness_drops(spark, tmp_path):
    out = [r for r in ran(windows(live(spark, tmp_path, LATE))) if isinstance(r, tuple)]
    assert sorted(out) == [("a", 0, 2, 59_999), ("b", 0, 1, 59_999), ("c", 60_000, 2, 119_999)]


def test_count_trigger_purges(spark, tmp_path):
    batches = [[(i * 1000, "a") for i in range(5)], [(100_000, "z")], [(300_000, "z")]]
    out = [r for r in ran(windows(live(spark, tmp_path, batches), trigger=CountTrigger(2, purge=True))) if isinstance(r, tuple) and r[0] == "a"]
    assert [r[2] for r in out] == [2, 2, 1]
    assert TriggerResult.FIRE_AND_PURGE & TriggerResult.PURGE


def test_restart_goes_on_from_checkpoint(spark, tmp_path):
    first = ran(windows(live(spark, tmp_path, LATE[:2])))
    assert not [r for r in first if isinstance(r, tuple)]
    again = [r for r in ran(windows(live(spark, tmp_path, [[(130_000, "c")], [(131_000, "c")]]))) if isinstance(r, tuple)]
    assert sorted(again) == [("a", 0, 2, 59_999), ("b", 0, 1, 59_999)]


def test_append_equals_batch(spark, tmp_path):
    batches = [[(i * 7_001 % 500_000, "ab"[i % 2]) for i in range(j, 200, 4)] for j in range(1)]
    stream = live(spark, tmp_path, batches, out_of_orderness_ms=10_000)
    counted = stream.window("w", event_time(60_000), aggregates=[F.count(F.lit(1)).alias("n")], keys=["k"])
    out = [r for r in ran(counted, "append") if isinstance(r, tuple)]
    latest = max(ms for b in batches for ms, _ in b)
    want = {}
    for b in batches:
        for ms, k in b:
            want[k, ms // 60_000] = want.get((k, ms // 60_000), 0) + 1
    assert sorted((r[0], r[3]) for r in out) == sorted((k, n) for (k, w), n in want.items() if (w + 1) * 60_000 <= latest - 10_000)


def test_watermark_reaches_the_sink(spark, tmp_path):
    stream = live(spark, tmp_path, [[(100_000, "a")], [(300_000, "a")], [(400_000, "a")]])
    counted = stream.window("w", event_time(60_000), aggregates=[F.count(F.lit(1)).alias("n")], global_key=True)
    marks = [r for r in ran(counted, "append") if isinstance(r, int)]
    assert marks == sorted(marks) and 100_000 in marks


def test_no_watermark_never_fires(spark, tmp_path):
    stream = live(spark, tmp_path, [[(1, "a")]], out_of_orderness_ms=None)
    counted = stream.window("w", event_time(10), aggregates=[F.count(F.lit(1)).alias("n")], keys=["k"])
    with pytest.raises(Exception, match="(?i)watermark"):
        ran(counted, "append")


def test_two_inputs_with_state(spark, tmp_path):
    stream = live(spark, tmp_path, [[(1, "a"), (2, "b")], [(3, "a")]])
    left = stream.map("l", "k", "ms")
    right = stream.map("r", "k", F.col("ms").alias("other"))

    def add(key, value, row):
        return value + 1, []

    def tell(key, value, row):
        return value + 100, [{"k": key[0], "seen": value}]

    both = connect_stream(left, right, "both", ["k"], add, tell, int, "k string, seen long")
    out = [r for r in ran(both, "append") if isinstance(r, tuple)]
    assert sorted(out) == [("a", 1), ("a", 102), ("b", 1)]


def test_mock_source(spark, tmp_path):
    env = Environment(spark, Options(checkpoint_dir=str(tmp_path)))
    s = env.from_source("m", mock.mock_stream(spark, number=10))
    got = []
    sinks.to_callbacks(s, "sink", lambda df, n: got.append(df.count()), lambda ms: None, once=False)
    env.start()
    import time

    until = time.time() + 60
    while len(got) < 2 and time.time() < until:
        time.sleep(0.1)
    env.stop()
    assert got[:2] == [10, 10]
    assert mock.mock_rows(spark, number=5, rounds=2).count() == 10


def test_source_of_ones_own(spark, tmp_path):
    class Numbers:
        def open(self):
            self.safe = 0

        def rows(self, start):
            end = min(start + 3, 7)
            return self.replay(start, end), end

        def replay(self, start, end):
            return [(i,) for i in range(start, end)]

        def committed(self, offset):
            self.safe = offset

        def close(self):
            pass

    env = Environment(spark, Options(checkpoint_dir=str(tmp_path)))
    s = env.from_source("n", source_stream(spark, "numbers", Numbers, "n long"))
    got = []
    sinks.to_callbacks(s, "sink", lambda df, n: got.extend(r.n for r in df.collect()), lambda ms: None, once=False)
    env.start()
    import time

    until = time.time() + 60
    while len(got) < 7 and time.time() < until:
        time.sleep(0.1)
    env.stop()
    assert sorted(got) == list(range(7))
