"""eventflow: event-stream analytics on Spark DataFrames, bounded and unbounded."""

from eventflow.environment import Environment, Options
from eventflow.session import session
from eventflow.stream import Stream

__all__ = ["Environment", "Options", "Stream", "session"]
