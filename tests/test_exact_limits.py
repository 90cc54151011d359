"""Amounts at and beyond what is summed exactly."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions import exact_sum


def total(spark, rows, *decimals):
    names = ["a", "b", "c"][: len(decimals)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    return df.agg(exact_sum(*zip(map(F.col, names), decimals)).alias("s")).first()["s"]


@pytest.mark.parametrize(
    "rows, decimals",
    [
        ([(2e12 + 0.125,), (0.01,), (-1e15,)], (2,)),
        ([(1e15 + 0.125,)], (2,)),
        ([(8e15 + 1.0,), (8.9e15,), (1.5,), (-7.1e15,), (0.000001,)], (2,)),
        ([(1e11 + 0.125, 999.125), (3.0, 0.5)], (2, 2)),
        ([(9e9, 1e5)], (2, 2)),
        ([(0.0, 900.5), (9e11, 0.0)], (2, 2)),
        ([(1e5 + 0.125, 1.125, 1.0625)], (2, 2, 2)),
    ],
)
def test_sums_within_the_limits_are_exact(spark, rows, decimals):
    wanted = 0
    for row in rows:
        product = Decimal(1)
        for x in row:
            product *= Decimal(repr(x))
        wanted += product
    assert total(spark, rows, *decimals) == wanted
    if len(decimals) == 1:  # and by another engine's decimals
        values = ", ".join(f"CAST({x!r} AS DECIMAL(38,6))" for (x,) in rows)
        assert duckdb.sql(f"SELECT sum(x) FROM (SELECT unnest([{values}]) AS x)").fetchall()[0][0] == wanted


@pytest.mark.parametrize(
    "rows, decimals",
    [
        ([(1e17,)], (2,)),
        ([(-1e300,)], (0,)),
        ([(2e12 + 0.125, 0.5)], (2, 2)),
        ([(1.0, 1500.125)], (2, 2)),
        ([(1e17, 0.0)], (2, 2)),
        ([(1e9, 1e9)], (2, 2)),
        ([(1e9, 1e9, 0.0)], (2, 2, 2)),
    ],
)
def test_larger_amounts_name_their_column(spark, rows, decimals):
    with pytest.raises(Exception, match="an amount in a is too large to be summed exactly"):
        total(spark, rows, *decimals)


def test_what_is_no_number_does_not_count(spark):
    inf, nan = float("inf"), float("nan")
    assert total(spark, [(inf,), (nan,), (-inf,), (None,), (1.5,)], 2) == Decimal("1.5")
    assert total(spark, [(inf, 2.0), (1e17, nan), (2.0, 0.5)], 2, 2) == Decimal(1)
