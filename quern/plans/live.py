"""Streaming queries, run until they have read what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.sources import stream_table
from quern.streaming import hourly_counts, run_to_table, session_for


def hourly_event_stream(
    spark: SparkSession,
    folder: str,
    state_partitions: int | None = None,
    max_bytes_per_batch: int | None = None,
) -> DataFrame:
    """Events and their value per hour and type, for the hours that are over.

    An hour is over once an event a full hour past its end has been seen.

    The state has the session's number of shuffle partitions unless the caller asks for
    fewer; it holds a row per open hour and type, so a few will do for a small feed.
    With ``max_bytes_per_batch`` a backlog is read in batches, so that a failure
    repeats one batch only; events in files that are out of time order by more than
    the watermark's hour are then left out.
    """
    events = stream_table(
        session_for(spark, state_partitions), folder, "events", max_bytes_per_batch
    )
    return run_to_table(hourly_counts(events), spark=spark)


QUERIES = {"hourly_event_stream": hourly_event_stream}

SQL = {
    "hourly_event_stream": """
        SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type,
               count(*) AS n_events,
               sum((CASE WHEN isfinite(value) THEN value END)::DECIMAL(18, 6))::DOUBLE AS total_value
        FROM events
        GROUP BY 1, 2
        HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 2 HOUR <= (
            SELECT date_trunc('millisecond', max(ts)) FROM events
        )
    """,
}
