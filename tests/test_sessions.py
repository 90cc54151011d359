from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from quern.operators import sessions

START = datetime(2024, 1, 1)
GAP = timedelta(minutes=30)


def by_session_window(df):
    return (
        df.groupBy("u", F.session_window("ts", "30 minutes"))
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.count(F.lit(1)).alias("n"),
        )
        .drop("session_window")
    )


def by_slots(df, rows_per_task):
    return sessions(df, "u", "ts", GAP, {"n": F.count(F.lit(1))}, rows_per_task)


@pytest.mark.parametrize("rows_per_task", [10**6, 60, 20])
def test_same_as_session_window(spark, rows_per_task):
    rng = random.Random(8)
    users = ["hot", "hot", None, *"abcdefgh"]
    rows = [
        (rng.choice(users), START + timedelta(seconds=rng.randrange(500_000)))
        for _ in range(3000)
    ]
    df = spark.createDataFrame(rows, "u string, ts timestamp_ntz")
    assert rows_of(by_slots(df, rows_per_task)) == rows_of(by_session_window(df))


@pytest.mark.parametrize("rows_per_task", [10**6, 1])
def test_a_pause_of_just_the_gap(spark, rows_per_task):
    at = [0, 30 * 60, 60 * 60, 90 * 60 + 0.000001]
    rows = [("a", START + timedelta(seconds=s)) for s in at]
    df = spark.createDataFrame(rows, "u string, ts timestamp_ntz")
    found = by_slots(df, rows_per_task)
    assert rows_of(found) == rows_of(by_session_window(df))
    assert sorted(r["n"] for r in found.collect()) == [1, 3]


@pytest.mark.parametrize("rows_per_task", [10, 1])
def test_rows_without_a_time(spark, rows_per_task):
    rows = [("a", None), ("a", START), ("a", None), ("b", None)]
    df = spark.createDataFrame(rows, "u string, ts timestamp_ntz")
    found = {tuple(r) for r in by_slots(df, rows_per_task).collect()}
    assert found == {("a", START, START, 1), ("a", None, None, 2), ("b", None, None, 1)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "u string, ts timestamp_ntz")
    assert by_slots(df, 10).collect() == []


def test_times_before_1970(spark):
    early = datetime(1969, 12, 31, 23, 40)
    rows = [("a", early + timedelta(minutes=m)) for m in (0, 25, 50, 81)]
    df = spark.createDataFrame(rows, "u string, ts timestamp_ntz")
    found = by_slots(df, 10)
    assert rows_of(found) == rows_of(by_session_window(df))
    assert sorted(r["n"] for r in found.collect()) == [1, 3]


def test_gaps_must_be_whole_seconds(spark):
    df = spark.createDataFrame([], "u string, ts timestamp_ntz")
    for gap in (timedelta(0), timedelta(milliseconds=1500), timedelta(seconds=-1)):
        with pytest.raises(ValueError):
            sessions(df, "u", "ts", gap, {})
