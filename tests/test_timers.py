import pytest
from hypothesis import given
from hypothesis import strategies as st

from eventflow.functions.windows import Tumbling
from eventflow.stateful.timers import BoundedOutOfOrderness, CombinedWatermark, Monotone, Timer, TimerQueue, WithIdleness


def test_two_inputs():
    w = CombinedWatermark(2)
    assert w.is_idle
    said = [w.update(i, t) for i, t in ((1, 2), (2, 1), (1, 3), (2, 3))]
    assert said == [True, False, False, True]
    assert not w.is_idle


def test_silent_input_is_ignored():
    w = CombinedWatermark(2)
    w.update(1, 1)
    assert all(w.update(1, i) for i in range(2, 100))
    assert w.watermark == 99


def test_idle_input_lets_others_go_on():
    w = CombinedWatermark(2)
    w.update(1, 1)
    w.update(2, 100)
    assert w.watermark == 1
    assert w.update_idle(1)
    assert w.watermark == 100


def test_idle_input_never_lowers():
    w = CombinedWatermark(2)
    w.update(1, 100)
    w.update(2, 1)
    assert w.watermark == 100
    assert not w.update_idle(1)
    assert w.watermark == 100


def queue():
    q = TimerQueue()
    for t in (Timer("tt", 2), Timer("t", 1), Timer("ttt", 3)):
        assert q.add(t)
    return q


def test_queue_order():
    q = queue()
    assert q.peek() == Timer("t", 1) and len(q) == 3
    assert [q.pop().payload for _ in range(3)] == ["t", "tt", "ttt"]
    assert q.pop() is None and len(q) == 0


def test_queue_remove_and_duplicates():
    q = queue()
    assert not q.add(Timer("t", 1))
    assert q.remove(Timer("t", 1))
    assert not q.remove(Timer("ttt", 3))
    assert q.peek() == Timer("tt", 2) and len(q) == 1


def test_queue_advance():
    assert [t.timestamp for t in queue().advance(2)] == [1, 2]


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 50))))
def test_queue_pops_sorted(timers):
    q = TimerQueue()
    for t in timers:
        q.add(Timer(*t))
    out = [t.timestamp for t in q.advance(50)]
    assert out == sorted(out) and len(out) == len(set(timers))


def test_generators():
    g = BoundedOutOfOrderness(5)
    assert g.current() is None
    for t in (10, 30, 20):
        g.on_event(t)
    assert g.current() == 24
    m = Monotone()
    assert [m.emit(x) for x in (None, -3, 0, 5, 5, 7)] == [False, False, False, True, False, True]
    assert m.mark_idle() and not m.mark_idle()
    assert m.emit(8) and not m.idle
    i = WithIdleness(BoundedOutOfOrderness(0), 100)
    i.on_event(1, now=1000)
    assert not i.is_idle(1099) and i.is_idle(1100)
    with pytest.raises(ValueError):
        BoundedOutOfOrderness(-1)


def test_window_bounds():
    w = Tumbling(7000, 2000)
    assert [w.start_of(t) for t in (-7000, -1, 0, 6999, 7000, 12345)] == [-12000, -5000, -5000, 2000, 2000, 9000]
    for bad in ((0, 0), (5, -1)):
        with pytest.raises(ValueError):
            Tumbling(*bad)


def test_window_column_agrees(spark):
    from pyspark.sql import functions as F

    w = Tumbling(7000, 2000)
    times = [-7000, -1, 0, 6999, 7000, 12345]
    df = spark.createDataFrame([(t,) for t in times], "ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = {r.ms: r.s for r in df.select("ms", F.unix_millis(w.column("ts")["start"]).alias("s")).collect()}
    assert got == {t: w.start_of(t) for t in times}
