"""Compare every query with its SQL, and time both, on larger and uneven tables.

    python scale_check.py FOLDER [COPIES] [ROWS_PER_TASK]

Writes COPIES (default 40) of the sf0.1 tables with shifted keys below FOLDER,
which must not exist yet; a third of the orders go to one customer, of the
lines to one order, and of the events to one user. With ROWS_PER_TASK, keys
above it are cut into chunks (see quern/operators/ordered.py).
"""

from __future__ import annotations

import inspect
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans import QUERIES, SQL
from quern.session import local_session
from quern.sources import table

SOURCE = "/root/testdata/sf0.1"

#: Keys to shift, by the number of them in the source.
KEYS = {
    "customer": {"c_custkey": 15_000},
    "supplier": {"s_suppkey": 1_000},
    "orders": {"o_orderkey": 150_000, "o_custkey": 15_000},
    "lineitem": {"l_orderkey": 150_000, "l_suppkey": 1_000},
    "events": {"event_id": 100_000, "user_id": 10_000},
}
HOT = {"orders": "o_custkey", "lineitem": "l_orderkey", "events": "user_id"}


def enlarged(df: DataFrame, name: str, copies: int) -> DataFrame:
    if name not in KEYS:
        return df
    every = F.sequence(F.lit(0), F.lit(copies - 1))
    many = df.withColumn("copy", F.explode(every))
    columns = {k: F.col(k) + F.col("copy") * n for k, n in KEYS[name].items()}
    if name in HOT:
        third = F.abs(F.hash(*df.columns, "copy")) % 3 == 0
        key = HOT[name]
        columns[key] = F.when(third, F.lit(7).cast("bigint")).otherwise(columns[key])
    return many.withColumns(columns).drop("copy").repartition(16)


def main(folder: str, copies: int = 40, rows_per_task: int | None = None) -> int:
    spark: SparkSession = local_session(app="quern-scale-check")
    duck = duckdb.connect()
    os.makedirs(folder)
    for name in ("region", "nation", *KEYS):
        path = f"{folder}/{name}.parquet"
        enlarged(table(spark, SOURCE, name), name, copies).write.parquet(path)
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")

    wrong = 0
    for name, query in QUERIES.items():
        options: dict[str, int] = {}
        if rows_per_task and "rows_per_task" in inspect.signature(query).parameters:
            options["rows_per_task"] = rows_per_task
        seconds = []
        for run in range(3):
            start = time.perf_counter()
            result = query(spark, folder, **options)
            result.write.parquet(f"{folder}/results/{name}-{run}")
            seconds.append(time.perf_counter() - start)
        start = time.perf_counter()
        duck.execute(f"CREATE TABLE expected_{name} AS {SQL[name]}")
        duck_seconds = time.perf_counter() - start
        columns = ", ".join(result.columns)
        found = f"(SELECT {columns} FROM '{folder}/results/{name}-0/*.parquet')"
        expected = f"(SELECT {columns} FROM expected_{name})"
        only_found, only_expected = (
            duck.execute(f"SELECT count(*) FROM ({a} EXCEPT ALL {b})").fetchall()[0][0]
            for a, b in ((found, expected), (expected, found))
        )
        wrong += bool(only_found or only_expected)
        print(
            f"{name:26} spark {min(seconds):7.2f}s  duckdb {duck_seconds:6.2f}s  "
            f"only here {only_found}  only in SQL {only_expected}",
            flush=True,
        )
    spark.stop()
    return wrong


if __name__ == "__main__":
    arguments = [int(a) for a in sys.argv[2:]]
    sys.exit(main(sys.argv[1], *arguments))
