"""The queries: plain functions ``(spark, folder) -> DataFrame``.

Each module ends in ``QUERIES`` and ``SQL``. The SQL says the same thing for
DuckDB, in the most direct way, and is what the results are compared with.
"""

from quern.plans import event_times, histories, live, summaries

_MODULES = (summaries, histories, event_times, live)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}

__all__ = ["QUERIES", "SQL"]
