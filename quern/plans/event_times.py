"""Events by time and by content."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import exact_sum, shown
from quern.operators import sessions
from quern.operators.ordered import ROWS_PER_TASK
from quern.sources import table

SESSION_GAP = timedelta(hours=6)


def hourly_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events and their value per hour and type; those without a time are kept."""
    zero = F.lit(0)
    start = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(zero, F.col("hour"))
    return (
        table(spark, folder, "events")
        .groupBy(
            F.col("ts").cast("date").alias("day"),
            F.hour("ts").alias("hour"),
            "event_type",
        )
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            shown(exact_sum((F.col("value"), 2))).alias("total_value"),
        )
        .select(start.alias("hour"), "event_type", "n_events", "total_value")
    )


def user_sessions(
    spark: SparkSession, folder: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Each user's runs of events no more than six hours apart."""
    measures = {
        "n_events": F.count(F.lit(1)),
        "total_value": exact_sum((F.col("value"), 2)),
    }
    events = table(spark, folder, "events")
    return sessions(
        events, "user_id", "ts", SESSION_GAP, measures, rows_per_task
    ).withColumn("total_value", shown(F.col("total_value")))


def events_per_property(spark: SparkSession, folder: str) -> DataFrame:
    """Events and their value per value of one property in their JSON.

    A property that is no whole number of a bigint's range, and one of malformed JSON,
    counts as missing.
    """
    k = F.get_json_object("props", "$.k")
    whole = F.when(k.rlike("^[+-]?[0-9]+$"), k.try_cast("bigint"))
    return (
        table(spark, folder, "events")
        .groupBy(whole.alias("k"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            shown(exact_sum((F.col("value"), 2))).alias("total_value"),
        )
    )


QUERIES = {
    "hourly_event_counts": hourly_event_counts,
    "user_sessions": user_sessions,
    "events_per_property": events_per_property,
}

SQL = {
    "hourly_event_counts": """
        SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type,
               count(*) AS n_events,
               sum((CASE WHEN isfinite(value) THEN value END)::DECIMAL(18, 6))::DOUBLE AS total_value
        FROM events
        GROUP BY 1, 2
    """,
    "user_sessions": """
        WITH marked AS (
            SELECT user_id, ts, value,
                   CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts
            FROM events
            WINDOW w AS (PARTITION BY user_id ORDER BY ts)
        ),
        numbered AS (
            SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session_no
            FROM marked
        )
        SELECT user_id,
               min(ts) AS first_ts,
               max(ts) AS last_ts,
               count(*) AS n_events,
               sum((CASE WHEN isfinite(value) THEN value END)::DECIMAL(18, 6))::DOUBLE AS total_value
        FROM numbered
        GROUP BY user_id, session_no
    """,
    "events_per_property": """
        SELECT CASE WHEN regexp_full_match(k, '[+-]?[0-9]+') THEN TRY_CAST(k AS BIGINT) END AS k,
               count(*) AS n_events,
               sum((CASE WHEN isfinite(value) THEN value END)::DECIMAL(18, 6))::DOUBLE AS total_value
        FROM (SELECT value,
                     CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k
              FROM events)
        GROUP BY 1
    """,
}
