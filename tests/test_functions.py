from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.functions import (
    exact_sum,
    micros_between,
    seconds_of,
    utc_instant,
    utc_wall_clock,
)


def test_exact_sum_of_amounts_and_products(spark):
    rows = [(0.1, 0.07), (-12345.67, 0.1), (99999999.99, 0.0), (None, 0.5), (0.3, None)]
    df = spark.createDataFrame(rows * 1000, "a double, b double")
    found = df.agg(
        exact_sum((F.col("a"), 2)).alias("a"),
        exact_sum((F.col("a"), 2), (F.lit(1.0) - F.col("b"), 2)).alias("ab"),
    ).first()
    exact = [tuple(None if v is None else Decimal(str(v)) for v in r) for r in rows]
    assert found["a"] == 1000 * sum(a for a, _ in exact if a is not None)
    assert found["ab"] == 1000 * sum(
        a * (1 - b) for a, b in exact if a is not None and b is not None
    )


def test_exact_sum_past_the_range_of_long(spark):
    df = spark.range(3000).select(F.lit(9_000_000_000_000_000.0).alias("a"))
    assert df.agg(exact_sum((F.col("a"), 0)).alias("a")).first()["a"] == 27 * 10**18


def test_exact_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "a double")
    assert df.agg(exact_sum((F.col("a"), 2)).alias("a")).first()["a"] is None


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Lord_Howe"])
def test_wall_clocks_survive_clock_changes(spark, settings, zone):
    settings(spark__sql__session__timeZone=zone)
    start = datetime(2024, 3, 9, 23, 59, 59, 123456)
    clocks = [start + timedelta(minutes=17 * i) for i in range(300)]
    clocks += [datetime(1969, 12, 31, 23, 0, 0, 1), datetime(2024, 11, 3, 1, 30)]
    df = spark.createDataFrame([(c,) for c in clocks], "c timestamp_ntz")
    instant = utc_instant(F.col("c"))
    clock = F.col("c")
    found = df.select(
        "c",
        utc_wall_clock(instant).alias("w"),
        F.unix_micros(instant).alias("m"),
        seconds_of(clock).alias("s"),
    )
    epoch = datetime(1970, 1, 1)
    for row in found.collect():
        assert row["w"] == row["c"]
        assert row["m"] == (row["c"] - epoch) // timedelta(microseconds=1)
        assert row["s"] == (row["c"] - datetime(1, 1, 1)) // timedelta(seconds=1)


def test_micros_between(spark, settings):
    settings(spark__sql__session__timeZone="America/New_York")
    a, b = datetime(2024, 3, 10, 1, 59, 59, 999999), datetime(2024, 3, 10, 3, 0, 0)
    df = spark.createDataFrame([(a, b), (b, a), (a, None)], "a timestamp_ntz, b timestamp_ntz")
    found = [r[0] for r in df.select(micros_between(F.col("a"), F.col("b"))).collect()]
    assert found == [3_600_000_001, -3_600_000_001, None]


def test_finer_amounts_are_summed_exactly(spark):
    values = [0.125, 0.375, 0.125, 0.004, 0.004, 0.004, 1.005, 12345.67, -0.000001, 99999999.123456]
    df = spark.createDataFrame([(v, 0.0625) for v in values] * 300, "a double, b double")
    found = df.agg(
        exact_sum((F.col("a"), 2)).alias("a"), exact_sum((F.col("a"), 2), (F.col("b"), 2)).alias("ab")
    ).first()
    exact = sum(Decimal(str(v)) for v in values)
    assert found["a"] == 300 * exact
    assert found["ab"] == 300 * exact * Decimal("0.0625")


def test_amounts_that_are_not_finite_do_not_count(spark):
    rows = [(1.25,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,), (0.5,)]
    df = spark.createDataFrame(rows, "a double")
    assert df.agg(exact_sum((F.col("a"), 2)).alias("a")).first()["a"] == Decimal("1.75")


def test_too_many_decimals_raise_an_error_with_the_name(spark):
    df = spark.createDataFrame([(1.0,), (1 / 3,)], "price double")
    with pytest.raises(Exception, match="price has more than 6 decimals"):
        df.agg(exact_sum((F.col("price"), 2)).alias("a")).collect()
    # The error of a double is not a decimal.
    df = spark.createDataFrame([(0.1 + 0.2,), (1.0 - 0.07,)], "price double")
    assert df.agg(exact_sum((F.col("price"), 2)).alias("a")).first()["a"] == Decimal("1.23")
