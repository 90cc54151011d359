"""Every query on empty tables, and on values that no fixture holds."""

from __future__ import annotations

import duckdb
import pytest
from conftest import DATA, TABLES, rows_of, rows_of_sql
from pyspark.sql import functions as F

from quern.plans import QUERIES, SQL
from quern.sources import table


def connected(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return connection


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        table(spark, f"{DATA}/sf0.001", name).limit(0).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert rows_of(QUERIES[name](spark, empty)) == rows_of_sql(connected(empty), SQL[name])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Finer amounts, amounts that are not finite, and JSON that is not as it should be."""
    folder = str(tmp_path_factory.mktemp("odd"))
    fine = F.array(*map(F.lit, [0.125, 0.375, 0.004, 1.005, 17.25, 0.000001]))
    wrong = F.array(*map(F.lit, [float("nan"), float("inf"), float("-inf"), 2.5]))
    texts = ['{"k": 1}', '{"k": "x"}', '{"k": 1.5}', '{"k": 99999999999999999999}', "{", '{"j": 1}', ""]
    for name in TABLES:
        df = table(spark, f"{DATA}/sf0.001", name)
        n = F.abs(F.hash(*df.columns))
        for column in ("value", "o_totalprice", "l_extendedprice", "l_quantity"):
            if column in df.columns:
                made = F.when(n % 5 == 0, F.get(wrong, n % 4)).otherwise(F.get(fine, n % 6))
                df = df.withColumn(column, F.when(n % 3 == 0, made).otherwise(F.col(column)))
        if "l_discount" in df.columns:
            df = df.withColumn("l_discount", F.when(n % 7 == 0, 0.0125).otherwise(F.col("l_discount")))
        if "props" in df.columns:
            some = F.get(F.array(*map(F.lit, texts)), F.col("event_id") % 14)
            df = df.withColumn("props", F.coalesce(some, F.col("props")))
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


#: Queries over amounts; the others do not add any up.
SUMS = [name for name in QUERIES if "isfinite" in SQL[name]]


@pytest.mark.parametrize("name", SUMS)
def test_odd_values(spark, odd, name):
    assert rows_of(QUERIES[name](spark, odd)) == rows_of_sql(connected(odd), SQL[name])
