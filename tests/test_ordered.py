"""Ordered steps against plain Python, with keys split and not."""

from __future__ import annotations

import random
from itertools import groupby

import pytest

from quern.operators import by_load, exact_quantile, with_prior, with_running_sum
from quern.operators import quantiles
from quern.operators.ordered import CHUNK, chunk_count, in_chunks, split_by_load

#: Rows per task: no key is hot; one is; many are.
LIMITS = [10_000, 300, 8]


def made_rows(seed: int) -> list[tuple]:
    """One key with a third of the rows, one null key, times with many ties."""
    rng = random.Random(seed)
    keys = ["hot"] * 500 + [None] * 150 + [f"k{i % 97}" for i in range(850)]
    rows = [
        (key, rng.randrange(40), i, rng.choice([None, *range(-3, 9)]))
        for i, key in enumerate(keys)
    ]
    rng.shuffle(rows)
    return rows


def made(spark, seed: int):
    rows = made_rows(seed)
    return rows, spark.createDataFrame(rows, "k string, t int, id bigint, v int")


def per_key(rows):
    ordered = sorted(rows, key=lambda r: (str(r[0]), r[1], r[2]))
    return [list(g) for _, g in groupby(ordered, key=lambda r: str(r[0]))]


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("seed", [1, 2])
def test_prior_row(spark, limit, seed):
    rows, df = made(spark, seed)
    keys, order = ["k"], ["t", "id"]
    prior = {"prior_id": "id", "prior_v": "v"}
    found = by_load(df, keys, order, lambda d: with_prior(d, keys, order, prior), limit)
    expected = set()
    for group in per_key(rows):
        for before, row in zip([None, *group], group):
            expected.add((*row, *((before[2], before[3]) if before else (None, None))))
    result = [tuple(r) for r in found.collect()]
    assert len(result) == len(rows)
    assert set(result) == expected


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("seed", [3, 4])
def test_running_sum(spark, limit, seed):
    rows, df = made(spark, seed)
    keys, order = ["k"], ["t", "id"]
    found = by_load(
        df, keys, order, lambda d: with_running_sum(d, keys, order, "v", "total"), limit
    )
    expected = set()
    for group in per_key(rows):
        total = None
        for row in group:
            if row[3] is not None:
                total = (total or 0) + row[3]
            expected.add((*row, total))
    result = [tuple(r) for r in found.collect()]
    assert len(result) == len(rows)
    assert set(result) == expected


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantile(spark, limit, q):
    rows, df = made(spark, 5)
    rows = [r if r[0] != "k5" else (*r[:3], None) for r in rows]
    df = spark.createDataFrame(rows, df.schema)
    found = exact_quantile(df, ["k"], "v", q, "q", limit)
    result = {r["k"]: r["q"] for r in found.collect()}
    assert len(result) == len(per_key(rows))
    for group in per_key(rows):
        values = sorted(r[3] for r in group if r[3] is not None)
        if not values:
            assert result[group[0][0]] is None
            continue
        at = q * (len(values) - 1)
        low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
        assert result[group[0][0]] == pytest.approx(low + (high - low) * (at - int(at)))


def test_quantile_of_one_value_over_and_over(spark):
    df = spark.range(5000).selectExpr("'a' AS k", "if(id < 4990, 1.5D, cast(id AS double)) AS v")
    found = exact_quantile(df, ["k"], "v", 0.5, "q", rows_per_task=100)
    assert [tuple(r) for r in found.collect()] == [("a", 1.5)]


def test_split_keeps_every_row_once(spark):
    rows, df = made(spark, 6)
    cold, hot, n = split_by_load(df, ["k"], 300)
    assert n == 500 and hot.count() == 500
    assert {r["k"] for r in hot.collect()} == {"hot"}
    assert sorted(r["id"] for r in cold.union(hot).collect()) == sorted(r[2] for r in rows)


def test_split_leaves_small_tables_alone(spark):
    _, df = made(spark, 7)
    assert split_by_load(df, ["k"], 10_000) == (df, None, 0)


def test_chunks_split_a_key_evenly_and_in_order(spark):
    df = spark.range(20_000).selectExpr("7 AS k", "(id * 7919) % 20000 AS t")
    cut = in_chunks(df, ["k"], ["t"], rows=20_000, rows_per_task=1000)
    parts = cut.groupBy(CHUNK).agg({"t": "min", "*": "count"}).toPandas()
    assert len(parts) >= 15
    assert parts["count(1)"].max() < 3000
    ordered = parts.sort_values(CHUNK)["min(t)"]
    assert ordered.is_monotonic_increasing


def test_chunks_grow_with_the_rows():
    assert chunk_count(0) == chunk_count(5_000_000) == 1
    assert chunk_count(5_000_001) == 2
    assert 10**12 / chunk_count(10**12) <= 5_000_000


def test_quantile_counts_once_and_sizes_chunks_from_the_counts(spark, monkeypatch):
    """Many rows, few values: chunks are of values, and the table is aggregated once."""
    df = spark.range(40_000).selectExpr("'a' AS k", "cast(id % 2000 AS double) AS v")
    written, cut = [], []
    through, chunks = quantiles.write_through, quantiles.in_chunks
    monkeypatch.setattr(quantiles, "write_through", lambda d: written.append(d) or through(d))

    def counted(*args):
        cut.append(chunks(*args))
        return cut[-1]

    monkeypatch.setattr(quantiles, "in_chunks", counted)
    found = exact_quantile(df, ["k"], "v", 0.5, "q", rows_per_task=1000)
    assert [tuple(r) for r in found.collect()] == [("a", 999.5)]
    assert len(written) == 1 and len(cut[0].inputFiles()) <= 2000 // 1000 + 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan  # what follows reads the written counts only
