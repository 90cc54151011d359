from __future__ import annotations

import math

import numpy as np
from quern.llm import toxicity
from tests.llm.rough import no_documents, rough_documents


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.op2_counterfactual_toxicity(spark, folder).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic = [r.score for r in held if r.toxic]
    clean = [r.score for r in held if not r.toxic]
    assert np.mean([[a > b for b in clean] for a in toxic]) > 0.85
    assert sum(s >= 0.3 for s in clean) <= 0.03 * len(clean)


def test_mentions_of_groups_are_made_neutral():
    """A group named mostly in toxic texts: its weight shrinks under the penalty."""
    rng = np.random.default_rng(8)
    labels, own, others = [], [], []
    for i in range(400):
        toxic = i % 2
        insult, group = toxic and rng.random() < 0.8, rng.random() < (0.6 if toxic else 0.1)
        ids = [0] * bool(insult) + [1] * bool(group)
        labels.append(toxic)
        own.append(ids)
        others.append([[0] * bool(insult) + [2]] if group else [])
    weights, _ = toxicity.fit_weights(np.array(labels, float), own, others, 3)
    plain, _ = toxicity.fit_weights(np.array(labels, float), own, [[]] * 400, 3)
    assert weights[0] > 1 and abs(weights[1] - weights[2]) < 0.5 * abs(plain[1])


def test_swaps_stay_within_a_kind():
    for group in toxicity.IDENTITY_TERMS:
        for term in group:
            other = toxicity.swapped({term}).pop()
            assert other != term and other in group


def test_rough_rows(spark):
    docs = rough_documents(spark)
    labels = spark.createDataFrame(
        [(4, 1, 1), (5, 1, 0), (6, 1, 0), (None, 1, 1), (7, 1, None), (999, 1, 1), (9, 0, 7)],
        "doc_id long, quality int, toxic int",
    )
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out is False for r in got if r.doc_id is None)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(no_documents(spark), labels)
    assert toxicity.scored(no_documents(spark), model).count() == 0
    row = toxicity.scored(rough_documents(spark), model).first()
    assert math.isclose(row.score, 0.5)
