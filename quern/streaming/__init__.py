"""Structured Streaming jobs."""

from quern.streaming.hourly import hourly_counts
from quern.streaming.runs import run_to_table, session_for

__all__ = ["hourly_counts", "run_to_table", "session_for"]
