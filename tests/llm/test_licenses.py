from __future__ import annotations

import re

import duckdb
import pytest
from quern.llm import licenses
from tests.conftest import rows_of, rows_of_sql
from tests.llm.rough import no_documents, rough_documents, small_documents

WORD = re.compile(licenses.WORD)


def places(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        wanted = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(wanted)] == wanted:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def check(docs):
    got = licenses.scanned(docs).collect()
    wanted = sorted(((r.doc_id, *places(r.text)) for r in docs.select("doc_id", "text").collect()), key=repr)
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == wanted
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1


def test_small_table(spark):
    check(small_documents(spark))


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = rows_of(licenses.op9_license_scan(spark, folder))
    assert got == rows_of_sql(connection, licenses.SQL["op9_license_scan"])


def test_rough_rows(spark):
    check(rough_documents(spark))


def test_empty_table(spark):
    assert licenses.scanned(no_documents(spark)).count() == 0


@pytest.mark.parametrize("label,text", licenses.TEMPLATES)
def test_every_template_is_its_own_copy(label, text):
    assert len(WORD.findall(text.lower())) >= licenses.GRAM


def test_copies_with_changes(spark):
    label, text = next(t for t in licenses.TEMPLATES if t[0] == "mit" and len(t[1]) > 200)
    words = text.split()
    less = " ".join(words[:20] + words[21:50] + ["indeed"] + words[50:])
    rows = [
        (1, "Before. " * 30 + text + " After."),
        (2, less.upper()),
        (3, " ".join(words[: len(words) // 2])),
        (4, " ".join(reversed(words))),
        (5, f"{text}\n{text}"),
        (6, "cc by cc by all rights reserved"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS found", "1 AS hash")
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    assert [got[i].labels for i in range(1, 7)] == [label, label, "", "", label, "cc-by,reserved"]
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (3, 0, 4)
    spans = licenses.copies(docs.filter("doc_id = 5")).collect()
    n = len(WORD.findall(text))
    assert sorted((s.start, s.end) for s in spans) == [(0, n), (n, 2 * n)]


def labels_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in licenses.scanned(docs).orderBy("doc_id").collect()]


def template(label, least=0):
    return next(t for name, t in licenses.TEMPLATES if name == label and len(t) > least)


def test_words_put_in_anywhere(spark):
    words = template("mit", 200).split()
    put = lambda at, n: " ".join(words[:at] + [f"x{i}" for i in range(n)] + words[at:])
    half = len(words) // 2
    texts = [put(half, 5), put(half, 40), put(half, 200), put(10, 30), " ".join(words[half:] + words[:half])]
    texts.append(" ".join(words[:15] + ["a b c d e f g h"] + words[15:40] + ["i j k l m n o"] + words[40:]))
    assert labels_of(spark, texts) == ["mit", "mit", "", "mit", "", "mit"]


def test_versions_of_one_license_are_told_apart(spark):
    names = ["gpl-3.0", "gpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0"]
    found = labels_of(spark, [template(n, 150) for n in names])
    assert [",".join(x for x in f.split(",") if x != "gpl") for f in found] == names


def test_short_forms(spark):
    texts = [
        "This is under CC BY-SA 4.0 now",
        "# SPDX-License-Identifier: MIT",
        "// SPDX-License-Identifier: Apache-2.0\nint x;",
        "CC0 1.0 Universal",
        "spdx license identifier of none",
        "Licensed under CC BY 4.0.",
    ]
    assert labels_of(spark, texts) == ["cc-by,cc-by-sa-4.0", "mit", "apache-2.0", "cc0-1.0", "", "cc-by,cc-by-4.0"]


def test_each_template_has_its_own_label(spark):
    found = labels_of(spark, [t for _, t in licenses.TEMPLATES])
    assert all(label in f.split(",") for (label, _), f in zip(licenses.TEMPLATES, found))


def test_hashes_alone_prove_nothing(spark, monkeypatch):
    """With all hashes equal the words still have to be."""
    from pyspark.sql import functions as F

    plain = licenses.gram_hashes
    monkeypatch.setattr(licenses, "gram_hashes", lambda words: F.transform(plain(words), lambda h: F.lit(7).cast("long")))
    text = template("mit", 200)
    assert labels_of(spark, [text, "no such words at all in here, none of them", text[::-1]]) == ["mit", "", ""]


def test_sql_on_changed_copies(spark):
    words = template("mit", 200).split()
    texts = [t for _, t in licenses.TEMPLATES] + [None, ""]
    texts += [" ".join(words[:i] + ["put", "in", "some", "more", "words"] + words[i:]) for i in range(0, len(words), 7)]
    texts += [template("gpl-3.0", 200) + " and " + template("gpl-2.0", 200), template("mit", 200) * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    assert rows_of(licenses.scanned(docs)) == rows_of_sql(connection, licenses.SQL["op9_license_scan"])
