"""Progress of running queries as metric rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from eventflow.sources.recorder import Recorder

#: kind: counter (value_long), gauge (value_double), timer (value_ms), histogram (bounds, samples)
SCHEMA = "kind string, name string, tags map<string,string>, value_long long, value_double double, value_ms long, bounds array<double>, samples array<long>, at timestamp"
BUCKETS_MS = (5.0, 10.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0)


def metric(kind: str, name: str, tags: dict[str, str] | None = None, value: float = 0, at: float | None = None) -> tuple:
    if kind not in ("counter", "gauge", "timer"):
        raise ValueError(f"no metric kind {kind!r}")
    import datetime

    when = datetime.datetime.fromtimestamp(time.time() if at is None else at, datetime.timezone.utc)
    return kind, name, tags or {}, int(value) if kind == "counter" else None, float(value) if kind == "gauge" else None, int(value) if kind == "timer" else None, None, None, when


_COLUMNS = ("kind", "name", "tags", "value_long", "value_double", "value_ms", "bounds", "samples", "at")


class MetricsCollector(StreamingQueryListener):
    """Listens from its making on, so nothing that a query reports is lost; rows go to files of ``folder`` every ``interval_ms``."""

    def __init__(self, spark: SparkSession, folder: str, interval_ms: int = 0):
        self.spark = spark
        self.recorder = Recorder(spark, folder, SCHEMA, _COLUMNS, interval_ms)
        self._durations: dict[str, list[int]] = {}
        self.checkpoints = {"total": 0, "succeeded": 0, "failed": 0}
        spark.streams.addListener(self)

    def report(self, *rows: tuple) -> None:
        self.recorder.report(*rows)

    def _checkpoint(self, tags: dict[str, str], how: str) -> list[tuple]:
        """What a coordinator of checkpoints would report: how many there were, how they ended."""
        self.checkpoints["total"] += 1
        self.checkpoints[how] += 1
        return [metric("counter", f"{how}_checkpoint", tags, 1), *(metric("gauge", f"{k}_checkpoints", tags, v) for k, v in self.checkpoints.items())]

    def onQueryStarted(self, event) -> None:
        self.report(metric("counter", "queries_started", {"query": str(event.name or event.id)}, 1))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        tags = {"query": str(p.name or p.id), "batch": str(p.batchId)}
        took = int((p.durationMs or {}).get("triggerExecution", 0))
        counts = self._durations.setdefault(tags["query"], [0] * (len(BUCKETS_MS) + 1))
        counts[next((i for i, b in enumerate(BUCKETS_MS) if took <= b), len(BUCKETS_MS))] += 1
        out = p.sink.numOutputRows if p.sink else -1
        rows = [metric("counter", "input_total", tags, p.numInputRows), metric("gauge", "input_rows_per_second", tags, p.processedRowsPerSecond or 0.0), metric("timer", "execute_duration", tags, took), metric("gauge", "last_checkpoint", tags, p.batchId), *self._checkpoint(tags, "succeeded")]
        if out >= 0:
            rows.append(metric("counter", "output_total", tags, out))
        for i, s in enumerate(p.stateOperators or []):
            at = tags | {"operator": str(i)}
            rows += [metric("gauge", "state_rows", at, s.numRowsTotal), metric("counter", "late_rows_dropped", at, s.numRowsDroppedByWatermark)]
        *_, when = rows[0]
        rows.append(("histogram", "execute_duration_ms", tags, None, None, None, list(BUCKETS_MS), list(counts), when))
        self.report(*rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        tags = {"query": str(event.id)}
        self.report(*(self._checkpoint(tags, "failed") if event.exception else [metric("counter", "queries_ended", tags, 1)]))

    def rows(self) -> DataFrame:
        return self.recorder.rows()

    def live(self) -> DataFrame:
        return self.recorder.live()

    def close(self) -> None:
        self.spark.streams.removeListener(self)
        self.recorder.close()
