from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from quern.llm import repeats
from tests.conftest import rows_of, rows_of_sql
from tests.llm.rough import no_documents, rough_documents, small_documents


def brute(rows, window):
    seen = Counter()
    bodies = [(k, (t or "").encode()) for k, t in rows]
    for _, b in bodies:
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for key, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((key, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, repeats.removals(docs).collect()), key=repr) == brute(rows, repeats.WINDOW)


def test_small_table(spark):
    check(small_documents(spark))


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = rows_of(repeats.op10_repeated_passages(spark, folder))
    assert got == rows_of_sql(connection, repeats.SQL["op10_repeated_passages"])


def test_rough_rows(spark):
    docs = rough_documents(spark)
    check(docs)
    left = repeats.without_repeats_rows(docs)
    assert left.columns == docs.columns and left.count() == docs.count()


def test_empty_table(spark):
    assert repeats.removals(no_documents(spark)).count() == 0
    assert repeats.without_repeats_rows(no_documents(spark)).count() == 0


@pytest.mark.parametrize("per_shard", [3, 4_000])
def test_passages_in_many_texts(spark, per_shard):
    """One passage at any place of many texts; with few contexts a shard, merged ones too."""
    rng = np.random.default_rng(2)
    letters = np.frombuffer(b"abcdefgh ", np.uint8)
    some = lambda n: bytes(rng.choice(letters, n)).decode()
    passage = some(450)
    rows = []
    for i in range(60):
        low = int(rng.integers(0, 120))
        part = passage[low : int(rng.integers(low + 180, 451))]
        rows.append((i, some(int(rng.integers(0, 300))) + part + some(int(rng.integers(0, 300)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    changed = repeats.without_repeats(docs, per_shard=per_shard)
    found = {(r.tid, r.size): (r.n_removed, r.n_spans, r.kept_sha256) for r in changed.collect()}
    keyed = docs.select("doc_id", *repeats.text_key()).collect()
    got = {r.doc_id: found.get((r.tid, r.size)) for r in keyed}
    for key, _, gone, runs, sha in brute(rows, repeats.WINDOW):
        assert got[key] == ((gone, runs, sha) if gone else None)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 3, (40, 9)).astype(np.uint64)
    symbols[7] = symbols[3]
    order = repeats.suffix_order(symbols)
    suffix = lambda s: symbols[s // 9, s % 9 :].tolist()
    told = [suffix(int(s)) for s in order]
    assert told == sorted(told) and sorted(order.tolist()) == list(range(360))
    shared = repeats.common_prefixes(symbols, order).tolist()
    for i in range(1, 360):
        a, b = told[i - 1], told[i]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[i] == n


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 101, 5000).astype(np.uint8))
    whole = repeats.anchors(text)
    monkeypatch.setattr(repeats, "_BLOCK", 700)
    cut = repeats.anchors(text)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def periodic_rows():
    """Runs of few bytes, alone, next to each other, and as long as a window allows."""
    rng = np.random.default_rng(8)
    some = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    texts = ["a" * 3000, "ab" * 900, some(37) * 60, some(150) * 9, some(199) * 4, some(200) * 3, some(201) * 3]
    texts += [some(300) + "x" * n + some(300) for n in (199, 200, 201, 232, 399, 400, 401, 900)]
    texts += ["=" * 500 + some(100) + "=" * 500, "-" * 700 + "=" * 700, "ab" * 400 + "ba" * 400, some(13) * 20 + some(13) * 40]
    unit = some(37)
    texts += [some(50) + unit * 12 + some(50), unit[9:] + unit * 30]
    return [(i, t) for i, t in enumerate(texts)]


def test_periodic_texts(spark, monkeypatch):
    check(spark.createDataFrame(periodic_rows(), "doc_id long, text string"))


@pytest.mark.parametrize("block", [1 << 19, 700])
def test_entries_cover_the_same_anchors(monkeypatch, block):
    monkeypatch.setattr(repeats, "_BLOCK", block)
    for _, text in periodic_rows():
        body = text.encode()
        at, mark = repeats.anchors(body)
        places = {}
        for p, m in zip(at.tolist(), mark.tolist()):
            places.setdefault((m, body[max(0, p - 168) : p + 200], min(p, 168)), []).append(p)
        entries = [z for f in repeats.placed_contexts(body) for z in zip(*(c.tolist() for c in f))]
        assert sum(e[4] for e in entries) == len(at)
        assert {p for own in places.values() for p in own} >= {p for e in entries for p in e[2:4]}
        if block > len(body) and text == "a" * 3000:
            assert len(entries) < 450 and len(at) > 2900


@pytest.mark.parametrize("unit", [b"a", bytes(range(60, 97))])
def test_long_periodic_text_has_few_entries(unit):
    body = unit * (3_000_000 // len(unit))
    assert sum(len(f[0]) for f in repeats.placed_contexts(body)) < 600
