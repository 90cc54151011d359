"""Time expressions that give the same answer in every session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_instant(wall_clock: Column) -> Column:
    """``timestamp_ntz`` read as UTC, as the ``timestamp`` that watermarks need.

    A plain cast would read it in the session time zone, where clock changes
    skip or repeat an hour.
    """
    return F.make_timestamp(
        F.year(wall_clock),
        F.month(wall_clock),
        F.day(wall_clock),
        F.hour(wall_clock),
        F.minute(wall_clock),
        F.extract(F.lit("SECOND"), wall_clock),
        F.lit("UTC"),
    )


def utc_wall_clock(instant: Column) -> Column:
    """The inverse of :func:`utc_instant`."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)).cast(
        "decimal(18,6)"
    )
    zero = F.lit(0)
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return epoch + F.make_dt_interval(zero, zero, zero, seconds)


def micros_between(earlier: Column, later: Column) -> Column:
    """Microseconds from one ``timestamp_ntz`` to another, as a bigint."""
    seconds = (later - earlier).cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(1_000_000)).cast("bigint")


def seconds_of(wall_clock: Column) -> Column:
    """Whole seconds of a ``timestamp_ntz`` since the year 1, as a bigint.

    Counted from there because the cast to bigint cuts towards zero.
    """
    start = F.expr("TIMESTAMP_NTZ '0001-01-01 00:00:00'")
    return (wall_clock - start).cast("interval second").cast("bigint")
