from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from quern.llm import sketches
from tests.llm.rough import no_documents, rough_documents, small_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def told(docs):
    """Key, length and edited text's hash of every row, by sorting all of them."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.mark, r.text))
    for i, r in enumerate(order):
        following = order[(i + 1) % len(order)].text
        quarter = len(r.text) // 4
        yield r.doc_id, r.text, r.text[: len(r.text) - quarter] + following[:quarter], following


def check(docs, off):
    wanted = {}
    for key, text, edited, following in told(docs):
        name = (key, len(text), hashlib.sha256(edited.encode()).hexdigest())
        wanted.setdefault(name, []).append((text, edited, following))
    got = sketches.edited_neighbours(docs).collect()
    assert len(got) == sum(map(len, wanted.values()))
    for r in got:
        # Ties and repeated rows too: each has one of the results that are left.
        left = wanted[r.doc_id, r.n_chars, r.edited_sha256]
        near = min(left, key=lambda t: abs(r.near_next - alike(t[0], t[2])))
        left.remove(near)
        text, edited, following = near
        assert abs(r.near_edited - alike(text, edited)) < off
        assert abs(r.near_next - alike(text, following)) < off
        assert abs(r.contained_in_next - contained(text, following)) < 2 * off
        assert abs(r.contained_in_edited - contained(text, edited)) < 2 * off
        assert abs(r.n_shingles - len(shingles(text))) <= 0.35 * len(shingles(text))
    assert not any(wanted.values())


def contained(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a) if a else 1.0


def test_small_table(spark):
    check(small_documents(spark), 0.16)


def test_rough_rows(spark):
    check(rough_documents(spark), 0.16)
    check(rough_documents(spark).filter("doc_id <> 7"), 0.16)
    check(rough_documents(spark).filter("doc_id = 6"), 0.16)


def uneven(spark, n=400):
    """Keys at the ends of their type, a third null, a hot one, repeats, equal texts."""
    text = lambda i: " ".join(f"w{i * j % 97}" for j in range(1, 4 + i % 30))
    rows = [(None, text(i % 150)) for i in range(n // 3)]
    rows += [(7, text(i)) for i in range(n // 4)] + [(7, "the same text again and again and again")] * (n // 8)
    rows += [(k, text(k % 11)) for k in (-(2**63), -(2**63) + 1, -(9 * 10**18), -1, 0, 9 * 10**18, 2**63 - 1)]
    rows += [(2**63 - 1, text(i)) for i in range(20)] + [(1000 + i, text(i)) for i in range(n // 4)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("per_range", [5_000, 20, 1])
def test_uneven_keys(spark, monkeypatch, per_range):
    monkeypatch.setattr(sketches, "RANGE_ROWS", per_range)
    monkeypatch.setattr(sketches, "COPIES", 1 + per_range % 7)
    check(uneven(spark), 0.16)


def test_ranges_are_even(spark, monkeypatch):
    """Neither null keys, nor one key, nor copies make a range that grows with the table."""
    monkeypatch.setattr(sketches, "RANGE_ROWS", 20)
    docs = uneven(spark, 4000)
    rows, keys = sketches.distinct_rows(docs.select(F.col("doc_id").alias("id"), "text"))
    ranges = sketches._range_of(rows.withColumn("mark", F.xxhash64("text")), docs.count(), keys)
    sizes = [r["count"] for r in ranges.groupBy("range").count().collect()]
    assert max(sizes) <= 60 and len(sizes) > 60
    assert rows.agg(F.sum("copies")).first()[0] == docs.count()


def test_many_repeated_keys_are_joined(spark, monkeypatch):
    docs = uneven(spark)
    monkeypatch.setattr(sketches, "RANGES", 2)
    rows, _ = sketches.distinct_rows(docs.select(F.col("doc_id").alias("id"), "text"))
    assert rows.agg(F.sum("copies")).first()[0] == docs.count()


def test_empty_table(spark):
    assert sketches.edited_neighbours(no_documents(spark)).count() == 0


def test_parts_merge_to_the_whole(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(low, low + 400))) for low in range(0, 4000, 396)]
    parts = spark.createDataFrame(rows, "g int, text string").withColumn("sketch", sketches.sketch(F.col("text")))
    merged = sketches.merge_all(parts, ["g"]).first().sketch
    whole = spark.createDataFrame([(" ".join(f"w{i}" for i in range(4360)),)], "text string")
    assert merged == whole.select(sketches.sketch(F.col("text"))).first()[0]
    count = whole.select(sketches.distinct_shingles(sketches.sketch(F.col("text")))).first()[0]
    assert abs(count - 4356) < 0.3 * 4356


def test_containment(spark):
    words = [f"w{i}" for i in range(3000)]
    table = spark.createDataFrame([(" ".join(words[:1000]), " ".join(words))], "a string, b string")
    a, b = sketches.sketch(F.col("a"), 512), sketches.sketch(F.col("b"), 512)
    row = table.select(sketches.containment(a, b, 512), sketches.containment(b, a, 512)).first()
    assert row[0] > 0.85 and abs(row[1] - 1 / 3) < 0.1
