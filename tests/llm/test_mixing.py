from __future__ import annotations

import duckdb
from pyspark.sql import functions as F
from quern.llm import mixing
from tests.conftest import rows_of
from tests.llm.rough import no_documents, rough_documents


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = mixing.op5_mix_to_weights(spark, folder)
    wanted = connection.execute(mixing.SQL["op5_mix_to_weights"])
    names = [d[0] for d in wanted.description]
    order = [names.index(c) for c in sorted(names)]
    assert rows_of(got) == sorted((tuple(r[i] for i in order) for r in wanted.fetchall()), key=repr)


def test_rough_rows(spark):
    docs = rough_documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by_source = {}
    for r, s in zip(rows, rows):
        assert 0 <= r.taken <= 2 * r.size and len(r.positions) == -(-r.taken // r.size if r.size else 0)
        assert all(0 <= p <= 1 for p in r.positions)
        by_source.setdefault(r.target, []).append(r.taken)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == sum(r.taken for r in rows)
    assert mixing.mix(docs).collect() == rows


def test_targets_are_capped_and_reshared(spark):
    totals = spark.createDataFrame([("aa", 10), ("ab", 100), ("ac", 100), ("z", 0)], "source_key string, source_size long")
    got = {r.source_key: r.target for r in mixing.targets(totals).collect()}
    # 315 words by weights 5, 2, 1, 5: the first stops at 20, the last at 0, then the second at 200.
    assert got == {"aa": 20.0, "ab": 196.66666666666666, "ac": 98.33333333333333, "z": 0.0}


def test_positions_invert_the_schedule(spark):
    table = spark.range(0, 101).selectExpr("id / 100.0d AS t")
    for slope in (-0.9, 0.0, 0.5):
        share = F.col("t") + slope * (F.col("t") * F.col("t") - F.col("t"))
        at = mixing.position(share * 7.0, F.lit(7.0), F.lit(slope))
        assert table.select(F.max(F.abs(at - F.col("t")))).first()[0] < 1e-12


def test_order_follows_positions(spark):
    places = [r.positions[0] for r in mixing.mix(rough_documents(spark)).collect() if r.positions]
    assert places == sorted(places)


def test_empty_table(spark):
    assert mixing.mix(no_documents(spark)).count() == 0
    assert mixing.mixed(no_documents(spark)).count() == 0
