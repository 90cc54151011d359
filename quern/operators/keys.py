"""Per-key steps that shrink every map task's rows before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_match(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of ``left`` whose key is nowhere in ``right``.

    The right keys are made distinct first. An anti join cannot split a key that
    is hot on its right side, and the distinct leaves one row of it per map task.
    """
    keys = right.select(F.col(right_key).alias(left_key)).distinct()
    return left.join(keys, left_key, "left_anti")


def latest_per_key(
    df: DataFrame, key: str, order: list[str], carry: list[str] | None = None
) -> DataFrame:
    """For each key, the values of ``order`` and ``carry`` in its last row.

    ``order`` must end in a column that makes it total. This is an aggregate,
    so a map task sends at most one row per key, however many rows a key has.
    """
    columns = [*order, *(carry or [])]
    last = df.groupBy(key).agg(F.max(F.struct(*columns)).alias("last"))
    return last.select(key, *(F.col("last")[name].alias(name) for name in columns))


def top_per_key(
    df: DataFrame, key: str, order: list[Column], k: int, rank: str = "rank_no"
) -> DataFrame:
    """The first ``k`` rows of each key, with their rank from 1.

    ``order`` must be total. The filter on ``row_number`` lets Spark cut each
    key to ``k`` rows within each map task, before the shuffle. It does so for
    ``k`` up to ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 unless
    set; raise that for more, or a hot key's rows all go to one task.
    """
    by_key = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(by_key))
    return ranked.filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))
