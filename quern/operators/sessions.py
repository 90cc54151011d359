"""Sessions: runs of a key's events with no gap of a given length."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import micros_between, seconds_of
from quern.operators.ordered import ROWS_PER_TASK, by_load, with_prior, with_running_sum
from quern.sources import write_through


def sessions(
    df: DataFrame,
    key: str,
    ts: str,
    gap: timedelta,
    measures: dict[str, Column],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per session: key, ``first_ts``, ``last_ts`` and additive ``measures``.

    An event more than ``gap`` after the one before it starts a new session, as
    with ``session_window``. That function sorts all events of a key in one
    task. Here the events are first summed up per (key, time slot one gap wide):
    two events in one slot are less than a gap apart and so always share a
    session. A key then has at most (time span / gap) rows to put in order,
    however many events it has.

    ``gap`` is whole seconds. A key's events without a time, which
    ``session_window`` drops, come out as one row without times.
    """
    seconds, rest = divmod(gap, timedelta(seconds=1))
    if seconds < 1 or rest:
        raise ValueError("the gap must be a whole number of seconds")
    micros = seconds * 1_000_000
    second = seconds_of(F.col(ts))
    slots = df.groupBy(
        key, (second - F.pmod(second, F.lit(seconds))).alias("_slot")
    ).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        *(m.alias(name) for name, m in measures.items()),
    )

    def numbered(rows: DataFrame) -> DataFrame:
        rows = with_prior(rows, [key], ["_slot"], {"_prior_ts": "last_ts"})
        pause = micros_between(F.col("_prior_ts"), F.col("first_ts"))
        starts = F.when(pause <= micros, 0).otherwise(1)
        rows = rows.withColumn("_starts", starts)
        return with_running_sum(rows, [key], ["_slot"], "_starts", "_session")

    if _slots_at_most(df, ts, micros) <= rows_per_task:
        rows = numbered(slots)
    else:
        rows = by_load(write_through(slots), [key], ["_slot"], numbered, rows_per_task)
    return (
        rows.groupBy(key, "_session")
        .agg(
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            *(F.sum(name).alias(name) for name in measures),
        )
        .drop("_session")
    )


def _slots_at_most(df: DataFrame, ts: str, micros: int) -> int:
    """The most slots that any key can have, from the table's time span."""
    span = df.agg(micros_between(F.min(ts), F.max(ts)).alias("span")).first()["span"]
    return 0 if span is None else span // micros + 2
