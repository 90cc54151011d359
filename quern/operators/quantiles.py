"""Exact quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordered import (
    CHUNK,
    ROWS_PER_TASK,
    in_chunks,
    join_small,
    split_by_load,
    with_running_sum,
)
from quern.sources import write_through


def exact_quantile(
    df: DataFrame,
    keys: list[str],
    value: str,
    q: float,
    name: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The ``q`` quantile of ``value`` per key, interpolated between two rows.

    ``percentile`` would hold every distinct value of a key in one task's
    memory. Here equal values are counted first, and a window, which can spill,
    ranks the counts. Where a key has very many distinct values, its counts are cut
    into ordered chunks, and only the chunks that hold the two wanted ranks are
    looked into. Nulls do not count; a key with nothing but nulls gets a null.
    """
    cells = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    if df.count() <= rows_per_task:  # then no key has more values
        return _pick(_ranked(cells, keys, value, q), keys, value, name)
    # Counted once and written, since they are read more than once below.
    cold, hot, hot_cells = split_by_load(write_through(cells), keys, rows_per_task)
    parts = []
    if cold is not None:
        parts.append(_pick(_ranked(cold, keys, value, q), keys, value, name))
    if hot is not None:
        cells = in_chunks(hot, keys, [value], hot_cells, rows_per_task)
        parts.append(_pick(_ranked_in_chunks(cells, keys, value, q), keys, value, name))
    return reduce(DataFrame.unionByName, parts)


def _position(count: Column, q: float) -> Column:
    return (count - 1) * F.lit(float(q))


def _ranked(cells: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Cells with ``_upto``, the rows up to and with each, and ``_at``."""
    count = F.sum("_n").over(Window.partitionBy(*keys))
    ranked = with_running_sum(cells, keys, [value], "_n", "_upto")
    return ranked.withColumn("_at", _position(count, q))


def _ranked_in_chunks(
    cells: DataFrame, keys: list[str], value: str, q: float
) -> DataFrame:
    """As :func:`_ranked`, for just the chunks that matter."""
    scope = [*keys, CHUNK]
    by_key = Window.partitionBy(*keys)
    through = F.sum("_sum").over(
        by_key.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    )
    # One row per (key, chunk).
    totals = (
        cells.groupBy(*scope)
        .agg(F.sum("_n").alias("_sum"))
        .withColumns({"_of": F.sum("_sum").over(by_key), "_through": through})
        .withColumn("_at", _position(F.col("_of"), q))
        .withColumn("_before", F.col("_through") - F.col("_sum"))
    )
    holds = (F.floor("_at") < F.col("_through")) & (F.ceil("_at") >= F.col("_before"))
    # A key with nothing but nulls has no ranks; its one row is kept for it.
    wanted = totals.filter(holds | (F.col("_of") == 0)).select(*scope, "_at", "_before")

    rows = join_small(cells, wanted, scope, "inner").withColumnRenamed(CHUNK, "_part")
    ranked = with_running_sum(rows, [*keys, "_part"], [value], "_n", "_within")
    return ranked.withColumn("_upto", F.col("_before") + F.col("_within"))


def _pick(ranked: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    low, high = F.floor("_at"), F.ceil("_at")

    def at(rank: Column) -> Column:
        # Ranks count from 0.
        here = (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
        return F.max(F.when(here, F.col(value)))

    found = ranked.groupBy(*keys).agg(
        F.max("_at").alias("_at"), at(low).alias("_low"), at(high).alias("_high")
    )
    between = (high - F.col("_at")) * F.col("_low") + (F.col("_at") - low) * F.col("_high")
    exact = F.when(low == high, F.col("_low")).otherwise(between)
    return found.select(*keys, exact.cast("double").alias(name))
