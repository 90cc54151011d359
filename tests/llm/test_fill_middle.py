from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quern.llm import fill_middle
from quern.llm.fill_middle import ERROR, RankIndex, op11_fill_in_middle, pieces, restored, transformed
from tests.conftest import rows_of, rows_of_sql
from tests.llm.rough import no_documents, rough_documents

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def boundaries(text: str) -> list[int]:
    return [0, *(m.end() for m in TOKEN.finditer(text))]


def check(text: str, error: int = ERROR) -> RankIndex:
    index, wanted = RankIndex(text, error), boundaries(text)
    assert index.n == len(wanted) - 1
    assert [index.offset(k) for k in range(index.n + 1)] == wanted
    return index


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abZ@[`{ \n\x00é🙂", max_size=400), st.sampled_from([0, 1, 5, ERROR]))
def test_every_cut_is_exact(text, error):
    check(text, error)


def test_stretches(monkeypatch):
    monkeypatch.setattr(fill_middle, "STRETCH", 7)
    for text in ("a" * 50, "ab cd" * 11, "é" * 14, "abcdefg" * 2 + " ", " abcdefg", "x" * 7, "x" * 8):
        check(text)


def test_long_texts():
    for text in ("a" * 3_000_000, " " * 2_500_000, "lorem ipsum dolor " * 120_000):
        index = RankIndex(text)
        wanted = boundaries(text)
        ranks = np.random.default_rng(1).integers(0, index.n + 1, 500)
        assert [index.offset(int(k)) for k in ranks] == [wanted[k] for k in ranks]
        assert len(index.ranks) <= 4  # one line a stretch


def test_pieces_are_as_long_as_a_line_allows():
    offsets = np.concatenate([np.arange(1000), 1000 + 9 * np.arange(1000)])
    found = list(pieces(offsets, 3))
    assert len(found) == 2 and abs(found[1][0] - 1000) < 5


def reference(key, text) -> tuple:
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    at = boundaries(text)
    n = len(at) - 1
    a, b = sorted((at[h[0] % (n + 1)], at[h[1] % (n + 1)]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return key, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_rough_rows(spark):
    marked = [(20 + i, t) for i, t in enumerate(["x <P> y", "<S>", "a<M>", "<<P >S> <", "ends with <", "<S"])]
    docs = rough_documents(spark)
    docs = docs.unionByName(spark.createDataFrame(marked, "doc_id long, text string"), allowMissingColumns=True)
    got = transformed(docs)
    rows = got.withColumn("back", restored(got["output"], got["form"])).collect()
    assert all(r.back == r.text for r in rows)
    found = sorted((tuple(r)[:5] + (r.output,) for r in rows), key=repr)
    assert found == sorted((reference(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert transformed(no_documents(spark)).count() == 0


def test_marks_at_cuts_do_not_confuse(spark):
    rows = [("psm", "<P>a<<S>S>b<M><P"), ("spm", "<S>S><<P>x<M>>"), ("psm", "<P><S><M>")]
    got = spark.createDataFrame(rows, "form string, output string")
    got = got.select(restored(got["output"], got["form"]).alias("t")).collect()
    assert [r.t for r in got] == ["a<<PS>b", "x>S><", ""]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = op11_fill_in_middle(spark, folder)
    assert rows_of(got) == rows_of_sql(connection, fill_middle.SQL["op11_fill_in_middle"])
    assert got.filter("output_sha256 <> restored_sha256").count() > 0
