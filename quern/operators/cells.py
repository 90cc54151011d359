"""Subtotals over every level of a set of dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finest(df: DataFrame, dims: list[str], measures: dict[str, Column]) -> DataFrame:
    # A rollup or cube straight over the rows copies each row once per level
    # before it aggregates. Subtotals of sums need only the finest cells.
    return df.groupBy(*dims).agg(*(m.alias(name) for name, m in measures.items()))


def _with_total(
    df: DataFrame, finest: DataFrame, grouped, dims: list[str], measures: dict[str, Column]
) -> DataFrame:
    sums = [F.sum(name).alias(name) for name in measures]
    whole = (1 << len(dims)) - 1
    level = F.grouping_id()
    below = grouped.agg(level.alias("level"), *sums).filter(F.col("level") != whole)
    # Spark makes no row for the total of an empty table, SQL does. The measures of no
    # rows, which cost nothing, are added to the total so that it is always there.
    none = df.limit(0).agg(*(m.alias(name) for name, m in measures.items()))
    total = finest.select(*measures).unionByName(none).agg(*sums)
    blank = [F.lit(None).cast(df.schema[d].dataType).alias(d) for d in dims]
    return below.unionByName(total.select(*blank, F.lit(whole).cast("bigint").alias("level"), *measures))


def rollup_of(df: DataFrame, dims: list[str], measures: dict[str, Column]) -> DataFrame:
    """``rollup`` of additive ``measures``, with ``level`` = the grouping id.

    The total over everything is there for an empty table too.
    """
    finest = _finest(df, dims, measures)
    return _with_total(df, finest, finest.rollup(*dims), dims, measures)


def cube_of(df: DataFrame, dims: list[str], measures: dict[str, Column]) -> DataFrame:
    """``cube`` of additive ``measures``, with ``level`` = the grouping id.

    The total over everything is there for an empty table too.
    """
    finest = _finest(df, dims, measures)
    return _with_total(df, finest, finest.cube(*dims), dims, measures)
