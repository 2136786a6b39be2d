"""Rows that the driver reports, kept as files: what metric and log streams are made of."""

from __future__ import annotations

import datetime
import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from eventflow.session import append_lines, make_folder


def _plain(value: object) -> str:
    if isinstance(value, datetime.datetime):
        return value.isoformat(timespec="microseconds")
    raise TypeError(f"{type(value)} can't be reported")


class Recorder:
    """Takes rows from any thread and writes them, every ``interval_ms`` and when asked to, as one JSON file each time.  Nothing is dropped."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, columns: tuple[str, ...], interval_ms: int = 0):
        self.spark, self.folder, self.schema, self.columns = spark, make_folder(spark, folder), schema, columns
        self._rows: list[tuple] = []
        self._guard, self._writing, self._n = threading.Lock(), threading.Lock(), 0
        self._stopped = threading.Event()
        if interval_ms:
            threading.Thread(target=self._every, args=(interval_ms / 1000,), daemon=True, name="eventflow-recorder").start()

    def _every(self, seconds: float) -> None:
        while not self._stopped.wait(seconds):
            self.flush()

    def report(self, *rows: tuple) -> None:
        with self._guard:
            self._rows += rows

    def flush(self) -> None:
        with self._writing:
            with self._guard:
                rows, self._rows = self._rows, []
            if rows:
                self._n += 1
                lines = [json.dumps(dict(zip(self.columns, r, strict=True)), default=_plain) for r in rows]
                append_lines(self.spark, self.folder, f"{self._n:08d}-{uuid.uuid4().hex}.json", lines)

    def rows(self) -> DataFrame:
        """All rows reported until now."""
        self.flush()
        return self.spark.read.schema(self.schema).json(self.folder)

    def live(self, files_per_batch: int | None = None) -> DataFrame:
        """The same, unbounded."""
        reader = self.spark.readStream.schema(self.schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.json(self.folder)

    def close(self) -> None:
        self._stopped.set()
        self.flush()
