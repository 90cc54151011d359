from __future__ import annotations

from pyspark.sql import functions as F

from conftest import rows_of
from quern.operators import cube_of, latest_per_key, rollup_of, top_per_key, without_match


def test_without_match_keeps_null_keys_and_repeats(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1,), (1,), (None,)], "r int")
    found = without_match(left, "k", right, "r")
    assert rows_of(found) == rows_of(left.filter("v != 'a'"))


def test_latest_per_key(spark):
    rows = [("a", 1, 1, "x"), ("a", 3, 1, "y"), ("a", 3, 2, "z"), ("b", None, 1, "n")]
    df = spark.createDataFrame(rows, "k string, t int, id int, v string")
    found = latest_per_key(df, "k", ["t", "id"], ["v"])
    assert sorted(tuple(r) for r in found.collect()) == [("a", 3, 2, "z"), ("b", None, 1, "n")]


def test_top_per_key(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id", "id % 10 AS v")
    found = top_per_key(df, "k", [F.col("v").desc(), F.col("id").asc()], 2)
    hot = [(r["id"], r["v"], r["rank_no"]) for r in found.filter("k = 0").collect()]
    assert sorted(hot) == [(9, 9, 1), (39, 9, 2)]
    assert found.filter("k != 0").count() == 666


def _levels(df):
    measures = {"n": F.count(F.lit(1)), "v": F.sum("v")}
    return measures, [m.alias(name) for name, m in measures.items()]


def test_subtotals_equal_the_direct_ones(spark):
    rows = [("a", "x", 1), ("a", None, 2), (None, "x", 4), ("b", "y", None), ("a", "x", 8)]
    df = spark.createDataFrame(rows, "p string, q string, v int")
    measures, aggregates = _levels(df)
    level = F.grouping_id().alias("level")
    direct = df.rollup("p", "q").agg(level, *aggregates)
    assert rows_of(rollup_of(df, ["p", "q"], measures)) == rows_of(direct)
    direct = df.cube("p", "q").agg(level, *aggregates)
    assert rows_of(cube_of(df, ["p", "q"], measures)) == rows_of(direct)
