"""A source of one's own as a Python data source: rows between offsets, told which are committed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Source:
    """``open`` before the first read, ``close`` after the last (where Spark ends a reader's process itself, it need not come).

    ``latest(start)`` says up to which offset rows can be read now; ``replay(start, end)`` gives the rows between two offsets, the same each
    time.  ``committed(offset)``: results up to there are safe.  A source that gives rows and the offset after them at once may have ``rows(start)`` in place of ``latest``.
    """

    def open(self) -> None:
        pass

    def latest(self, start: int) -> int:
        raise NotImplementedError("a source says what can be read: define latest or rows")

    def replay(self, start: int, end: int) -> Iterator[tuple] | list[tuple]:
        raise NotImplementedError("a source gives rows: define replay")

    def committed(self, offset: int) -> None:
        pass

    def close(self) -> None:
        pass


class _Part(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceStreamReader):
    """Offsets are decided on the driver; ``parts`` tasks read the rows between them, each with a source that it opens and closes."""

    def __init__(self, make: Callable[[], Source], parts: int):
        self.make, self.parts, self.own, self.at = make, parts, None, 0

    def __getstate__(self) -> dict:
        return {"make": self.make, "parts": self.parts, "own": None, "at": 0}

    @property
    def source(self) -> Source:
        if self.own is None:
            self.own = self.make()
            self.own.open()
        return self.own

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        source = self.source
        self.at = source.rows(self.at)[1] if hasattr(source, "rows") else max(self.at, source.latest(self.at))
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = start["at"], end["at"]
        self.at = max(self.at, hi)
        edges = sorted({lo + (hi - lo) * k // self.parts for k in range(self.parts + 1)})
        return [_Part(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        source = self.make()
        source.open()
        try:
            yield from source.replay(partition.start, partition.end)
        finally:
            source.close()

    def commit(self, end: dict) -> None:
        self.source.committed(end["at"])

    def stop(self) -> None:
        if self.own is not None:
            self.own.close()


def source_stream(spark: SparkSession, name: str, make: Callable[[], Source], schema: str, parts: int = 1) -> DataFrame:
    """A stream of the source that ``make`` gives; the rows of a batch are read by ``parts`` tasks."""
    if parts < 1:
        raise ValueError("one part or more")

    class Own(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(make, parts)

    spark.dataSource.register(Own)
    return spark.readStream.format(name).load()
