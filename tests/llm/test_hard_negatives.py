from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from quern.llm import hard_negatives
from quern.llm.hard_negatives import LIMIT, mined, op13_hard_negatives, share
from tests.conftest import rows_of, rows_of_sql

SCHEMA = "vec_id long, embedding array<float>, label int"


def reference(rows, label=lambda i, y: y) -> list[tuple]:
    """All pairs, one by one."""
    good = []
    for i, v, y in rows:
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label(i, y)))
    out = []
    for a, (i, v, y) in enumerate(good):
        if i is None or i % 100:
            continue
        near = [
            (-max(-LIMIT, min(LIMIT, sum(p * q for p, q in zip(v, w)))), j is None, j or 0, j, z)
            for b, (j, w, z) in enumerate(good)
            if b != a
        ]
        near.sort(key=lambda r: r[:3])
        for p in [r for r in near if r[4] == y][:5]:
            window = [n for n in near if n[4] != y and -30 * p[0] <= -100 * n[0] <= -90 * p[0]]
            out += [(i, p[3], k + 1, n[3], -p[0], -n[0]) for k, n in enumerate(window[:10])]
    return sorted(out, key=repr)


def made(spark, rows, **more) -> list[tuple]:
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, mined(table, F.col("id") % 100 == 0, **more).collect()), key=repr)


def some_rows(n, labels=4, seed=1, width=6):
    random = np.random.default_rng(seed)
    # Few values, so that there are many ties.
    vectors = random.integers(-3, 5, (n, width)) / 4
    return [(int(i), [float(x) for x in v], int(random.integers(labels))) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("block", [65_536, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = some_rows(430)
    assert made(spark, rows) == reference(rows) != []


def test_rough_rows(spark):
    rows = some_rows(230, labels=2, width=3)
    nan, inf = float("nan"), float("inf")
    rows += [
        (None, [1.0, 1.0, 1.0], 0),
        (None, [1.0, 1.0, 1.0], 1),
        (300, None, 1),
        (400, [1.0, None, 1.0], 1),
        (500, [1.0, nan, 1.0], 1),
        (600, [1.0, -inf, 1.0], 1),
        (700, [1.0, 1.0, 1.0], None),
        (800, [], 1),
        (900, [1.0], 0),
        (1000, [1.0, 1.0, 1.0, 5.0, 7.0], 0),
        (1100, [1.0, 1.0, 1.0], 7),  # the only one of its label
        (100, [0.5, 0.75, 1.0], 0),  # a repeated key
        (1200, [0.5, 0.75, 1.0], 0),
        (1200, [0.5, 0.75, 1.0], 0),
    ]
    assert made(spark, rows) == reference(rows)


def test_scores_beyond_doubles(spark):
    rows = [(i, [1e5 + i / 8, 3e30 if i == 107 else 2.5 * (i % 9), 1e6 * (3 + i % 7)], i % 2) for i in range(90, 130)]
    rows += [(200, [1e6, 9e35, 1.0], 0), (201, [1.0, 8e35, 1.0], 0)]
    assert made(spark, rows) == reference(rows) != []


def test_most_rows_of_one_kind(spark):
    rows = some_rows(300, labels=1) + [(1000 + i, [0.5] * 6, 5) for i in range(40)]
    assert made(spark, rows) == reference(rows) != []


def test_shares_are_exact(spark):
    values = [0, 1, 9, 10, 11, 99, 100, 101, -1, -10, -99, -100, 4_000_037, LIMIT, -LIMIT, LIMIT - 13]
    table = spark.createDataFrame([(v,) for v in values], "p long")
    got = table.select("p", share(F.col("p"), 30, True).alias("low"), share(F.col("p"), 90, False).alias("high"))
    for r in got.collect():
        assert r.low == -(-30 * r.p // 100) and r.high == 90 * r.p // 100


def test_empty_table(spark):
    assert made(spark, []) == []


def test_clashing_columns(spark):
    rows = some_rows(120)
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("rid", "id", "block", "vector", "rank", "score", "slot", "anchor"):
        table = table.withColumn(name, F.lit("other"))
    got = sorted(map(tuple, mined(table, F.col("id") % 100 == 0).collect()), key=repr)
    assert got == reference(rows) != []


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = rows_of(op13_hard_negatives(spark, folder))
    assert got == rows_of_sql(connection, hard_negatives.SQL["op13_hard_negatives"]) != []
