"""Steps that need the rows of a key in order.

A window sorts all rows of a key in one task. That is the right plan until one
key holds a large part of the table. The rows of such keys are range-partitioned
on key *and* order into chunks of even size, however the keys are distributed,
and written out; the window then runs within (key, chunk), and what a chunk
needs from the chunks before it is a single row per (key, chunk).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources import write_through

#: Rows of one key that one task may sort.
ROWS_PER_TASK = 5_000_000

#: Hot keys at most. What is collected and broadcast is a row for each of them and for
#: each chunk, of which there is one for every ``ROWS_PER_TASK`` hot rows.
MAX_HOT_KEYS = 100_000

CHUNK = "_chunk"


def ascending(columns: list[str]) -> list[Column]:
    """The one order used here: nulls come last."""
    return [F.col(c).asc_nulls_last() for c in columns]


def join_small(left: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Broadcast ``small`` and join on ``on``, where null matches null."""
    renamed = {c: f"_small_{c}" for c in on}
    right = F.broadcast(small.withColumnsRenamed(renamed))
    match = [F.col(c).eqNullSafe(F.col(r)) for c, r in renamed.items()]
    joined = left.join(right, reduce(lambda a, b: a & b, match), how)
    return joined.drop(*renamed.values())


def split_by_load(
    df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK
) -> tuple[DataFrame | None, DataFrame | None, int]:
    """``(rows of ordinary keys, rows of hot keys, number of hot rows)``.

    A key is hot above ``rows_per_task`` rows, or above 1/100,000 of the table
    if that is more; so there are fewer than 100,000 hot keys, few enough to
    collect and broadcast. A table within ``rows_per_task`` is not looked at
    beyond its row count. A part without rows is None.
    """
    total = df.count()
    if total <= rows_per_task:
        return df, None, 0
    limit = max(rows_per_task, math.ceil(total / MAX_HOT_KEYS))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > limit).collect()
    if not hot:
        return df, None, 0
    hot_rows = sum(row["_n"] for row in hot)
    hot_keys = df.sparkSession.createDataFrame(hot, counts.schema).drop("_n")
    cold = join_small(df, hot_keys, keys, "left_anti") if hot_rows < total else None
    return cold, join_small(df, hot_keys, keys, "left_semi"), hot_rows


def chunk_count(rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """As many chunks as keep each at ``rows_per_task`` rows on average."""
    return max(1, -(-rows // rows_per_task))


def in_chunks(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rows: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``df`` with ``CHUNK``, the number of a run of the order ``(*keys, *order)``.

    ``rows`` is the number of rows, or an upper bound. The runs come from
    sampled bounds, so they are written once and read from there; computing
    them again could cut elsewhere.
    """
    parts = chunk_count(rows, rows_per_task)
    cut = df.repartitionByRange(parts, *ascending([*keys, *order]))
    return write_through(cut.withColumn(CHUNK, F.spark_partition_id()))


def with_prior(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]
) -> DataFrame:
    """Add ``columns`` (new name -> source) from the row before, per key.

    ``df`` is either plain rows or the result of :func:`in_chunks`.
    """
    if CHUNK not in df.columns:
        by_key = Window.partitionBy(*keys).orderBy(*ascending(order))
        return df.withColumns({n: F.lag(c).over(by_key) for n, c in columns.items()})
    scope = [*keys, CHUNK]
    in_chunk = Window.partitionBy(*scope).orderBy(*ascending(order))
    carry = F.struct(*(F.col(c).alias(n) for n, c in columns.items()))
    # What the last row of each (key, chunk) hands to the key's next chunk.
    before = Window.partitionBy(*keys).orderBy(CHUNK)
    rank = F.struct(*(part for c in order for part in (F.col(c).isNull(), F.col(c))))
    handed = (
        df.groupBy(*scope)
        .agg(F.max_by(carry, rank).alias("_last"))
        .select(*scope, F.lag("_last").over(before).alias("_handed"))
    )
    rows = df.withColumns(
        {
            "_first": F.row_number().over(in_chunk) == 1,
            "_within": F.lag(carry).over(in_chunk),
        }
    )
    rows = join_small(rows, handed, scope, "left")
    prior = F.when(F.col("_first"), F.col("_handed")).otherwise(F.col("_within"))
    return rows.select(*df.columns, *(prior[n].alias(n) for n in columns))


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[str], source: str, name: str
) -> DataFrame:
    """Add ``name``, the sum of ``source`` up to and with each row, per key.

    ``df`` is either plain rows or the result of :func:`in_chunks`.
    """
    scope = [*keys, CHUNK] if CHUNK in df.columns else keys
    so_far = Window.partitionBy(*scope).orderBy(*ascending(order))
    rows = df.withColumn(
        name, F.sum(source).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    )
    if scope is keys:
        return rows
    before = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = (
        df.groupBy(*scope)
        .agg(F.sum(source).alias("_sum"))
        .select(
            *scope,
            F.sum("_sum")
            .over(before.rowsBetween(Window.unboundedPreceding, -1))
            .alias("_carried"),
        )
    )
    total = F.coalesce(F.col("_carried") + F.col(name), F.col(name), F.col("_carried"))
    return join_small(rows, carried, scope, "left").select(*df.columns, total.alias(name))


def by_load(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    step: Callable[[DataFrame], DataFrame],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Apply ``step`` to the rows, with those of hot keys in chunks.

    ``order`` must be total within a key, or the chunks could not split it.
    """
    cold, hot, hot_rows = split_by_load(df, keys, rows_per_task)
    parts = [] if cold is None else [step(cold)]
    if hot is not None:
        rows = in_chunks(hot, keys, order, hot_rows, rows_per_task)
        parts.append(step(rows).drop(CHUNK))
    return reduce(DataFrame.unionByName, parts)
