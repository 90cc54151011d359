from __future__ import annotations

import hashlib
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from quern.llm import line_rules
from quern.llm.common import documents
from quern.sources import write_through
from tests.llm.rough import SCHEMA, rough_documents
from tests.llm.test_near_copies import groups_of
from tests.llm.test_repeats import brute as repeats_of
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_against_brute_force(spark):
    docs = documents(spark, FOLDER)
    kept = write_through(stage("quality rules")(spark, docs, FOLDER))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    verdicts = line_rules.verdicts(docs, line_rules.fit(docs, labels)).filter("kept")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in verdicts.collect())
    assert 0 < kept.count() < docs.count()

    single = write_through(stage("SimHash near-dedup")(spark, kept, FOLDER))
    rows = sorted(kept.collect())
    groups = groups_of([r.text for r in rows])
    assert sorted(single.collect()) == [rows[i] for i in sorted(set(groups))]

    cut = write_through(stage("suffix-array dedup")(spark, single, FOLDER))
    wanted = {k: (size - gone, sha) for k, size, gone, _, sha in repeats_of(
        [(r.doc_id, r.text) for r in single.collect()], 200
    )}
    for r in cut.collect():
        body = r.text.encode()
        if len(body) == wanted[r.doc_id][0]:  # else a character was cut in two
            assert hashlib.sha256(body).hexdigest() == wanted[r.doc_id][1]
        else:
            assert 0 < wanted[r.doc_id][0] - len(body) < 20

    mixed = write_through(stage("mixing sources to target weights")(spark, cut, FOLDER))
    assert mixed.columns == docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    before, after = Counter(), Counter()
    for r in cut.collect():
        before[r.source] += words(r.text)
    for r in mixed.collect():
        after[r.source] += words(r.text)
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) <= len(before)
    assert all(after[s] <= 2 * before[s] for s in before)

    pieces = stage("packing")(spark, mixed, FOLDER).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [tokenizer.encode(r.text, add_special_tokens=False).ids for r in mixed.collect()]
    assert sum(p.length for p in pieces) == sum(len(i) + 1 for i in ids)


def test_rough_rows(spark):
    docs = rough_documents(spark, clashes=False)
    for name, apply in corpus_pipeline.STAGES:
        docs = write_through(apply(spark, docs, FOLDER))
    assert docs.columns[0] == "doc_id"


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, apply in corpus_pipeline.STAGES:
        docs = write_through(apply(spark, docs, FOLDER))
    assert docs.count() == 0
