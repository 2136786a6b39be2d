"""Log records as rows."""

from __future__ import annotations

import datetime
import logging

from pyspark.sql import DataFrame, SparkSession

from eventflow.sources.recorder import Recorder

SCHEMA = (
    "level int, time timestamp, logger_name string, message string, caller struct<defined:boolean,file:string,line:int,function:string>, stack string, "
    "fields array<struct<key:string,type:string,integer:bigint,string:string>>"
)
_LEVELS = ((logging.DEBUG, -1), (logging.INFO, 0), (logging.WARNING, 1), (logging.ERROR, 2), (logging.CRITICAL, 5))
_OWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


def level_of(record_level: int) -> int:
    """-1 debug, 0 info, 1 warning, 2 error, 5 fatal."""
    return next((ours for theirs, ours in reversed(_LEVELS) if record_level >= theirs), -1)


_COLUMNS = ("level", "time", "logger_name", "message", "caller", "stack", "fields")


class LogCollector(logging.Handler):
    """A handler that records from its making on, whether or not anything reads yet; rows go to files of ``folder`` every ``interval_ms``."""

    def __init__(self, spark: SparkSession, folder: str, interval_ms: int = 0, logger: str = "eventflow"):
        super().__init__(logging.NOTSET)
        self.recorder = Recorder(spark, folder, SCHEMA, _COLUMNS, interval_ms)
        self._logger = logging.getLogger(logger)
        self._logger.addHandler(self)

    def emit(self, record: logging.LogRecord) -> None:
        fields = []
        for k, v in vars(record).items():
            if k not in _OWN:
                whole = isinstance(v, int) and not isinstance(v, bool) and -(2**63) <= v < 2**63
                fields.append({"key": k, "type": type(v).__name__, "integer": v if whole else None, "string": None if whole else str(v)})
        caller = {"defined": True, "file": record.pathname, "line": record.lineno, "function": record.funcName}
        when = datetime.datetime.fromtimestamp(record.created, datetime.timezone.utc)
        self.recorder.report((level_of(record.levelno), when, record.name, record.getMessage(), caller, self.format_exception(record), fields))

    @staticmethod
    def format_exception(record: logging.LogRecord) -> str | None:
        return logging.Formatter().formatException(record.exc_info) if record.exc_info else record.stack_info

    def rows(self) -> DataFrame:
        return self.recorder.rows()

    def live(self) -> DataFrame:
        return self.recorder.live()

    def detach(self) -> None:
        self._logger.removeHandler(self)
        self.recorder.close()
