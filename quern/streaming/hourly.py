"""Hourly totals of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import exact_sum, shown, utc_instant, utc_wall_clock


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Count and value per hour and type; events up to ``delay`` late are counted.

    The state holds one row per open hour and type. Each task sums its own rows
    first, so a busy hour or type is one row per task in the shuffle. An event
    without a time is in no hour and not counted.
    """
    return (
        events.withColumn("at", utc_instant(F.col("ts")))
        .withWatermark("at", delay)
        .groupBy(F.window("at", "1 hour"), "event_type")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            shown(exact_sum((F.col("value"), 2))).alias("total_value"),
        )
        .select(
            utc_wall_clock(F.col("window.start")).alias("hour"),
            "event_type",
            "n_events",
            "total_value",
        )
    )
