"""Every query on tables with nulls, hot keys, repeats and several files each."""

from __future__ import annotations

import inspect

import duckdb
import pytest
from conftest import DATA, TABLES, rows_of, rows_of_sql
from pyspark.sql import functions as F

from quern.plans import QUERIES, SQL
from quern.sources import table

#: Columns of which a third of the rows get one and the same value.
HOT = {"orders": "o_custkey", "lineitem": "l_orderkey", "events": "user_id"}

#: Their rows must have distinct ids, or orders would not be total.
IDS = {"orders": "o_orderkey", "events": "event_id"}


@pytest.fixture(scope="module")
def rough(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rough"))
    for name in TABLES:
        df = table(spark, f"{DATA}/sf0.01", name)
        columns = {}
        for i, column in enumerate(df.columns):
            if column == IDS.get(name):
                continue
            value = F.col(column)
            if column == HOT.get(name):
                third = F.hash(*df.columns) % 3 == 0
                value = F.when(third, F.lit(5).cast("bigint")).otherwise(value)
            if name not in ("region", "nation"):
                kept = F.abs(F.hash(*df.columns, F.lit(i))) % 23 != 0
                value = F.when(kept, value)
            columns[column] = value
        df = df.withColumns(columns)
        if name == "lineitem":
            df = df.unionAll(df.filter(F.hash("l_extendedprice") % 10 == 0))
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def rough_duck(rough):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM '{rough}/{name}.parquet/*.parquet'"
        )
    return connection


def limits(query) -> list[int | None]:
    splits = "rows_per_task" in inspect.signature(query).parameters
    return [None, 1000] if splits else [None]


CASES = [(name, limit) for name, query in QUERIES.items() for limit in limits(query)]


@pytest.mark.parametrize("name, limit", CASES)
def test_same_rows(spark, rough, rough_duck, name, limit):
    options = {} if limit is None else {"rows_per_task": limit}
    expected = rows_of_sql(rough_duck, SQL[name])
    assert expected
    assert rows_of(QUERIES[name](spark, rough, **options)) == expected


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_without_broadcasts(spark, settings, rough, rough_duck, name):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )
    assert rows_of(QUERIES[name](spark, rough)) == rows_of_sql(rough_duck, SQL[name])
