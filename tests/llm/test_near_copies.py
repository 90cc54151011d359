from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest
from quern.llm import near_copies
from tests.llm.rough import SCHEMA, no_documents, rough_documents, small_documents

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return set()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def groups_of(texts):
    """The number of each text's group, by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if alike(a, sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def near_texts():
    """Texts with copies whose similarity is between 0.8 and 0.95, and some just below."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    out, similar = [], []
    for n in (40, 120, 400, 1500):
        for _ in range(12):
            base = [rng.choice(words) for _ in range(n)]
            out.append(" ".join(base))
            for edits in range(1, 1 + n // 25):
                if edits > 3 and rng.random() < 0.7:
                    continue
                copy = list(base)
                for at in rng.sample(range(n), edits):
                    copy[at] = rng.choice(words)
                out.append(" ".join(copy))
                a, b = shingles(" ".join(base)), shingles(out[-1])
                similar.append(len(a & b) / len(a | b))
    assert sum(0.8 <= s <= 0.95 for s in similar) > 50 and sum(0.6 < s < 0.8 for s in similar) > 5
    return out


@pytest.mark.parametrize("chunk", [3, 256])
def test_stage_drops_near_copies(spark, chunk):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    if chunk == 256:
        got = corpus_pipeline.simhash_near_dedup(spark, docs, FOLDER)
    else:
        got = near_copies.one_per_group(docs, chunk=chunk)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(groups_of(texts)))


def test_small_table(spark):
    rows = sorted(small_documents(spark).collect())
    got = near_copies.one_per_group(small_documents(spark))
    assert sorted(got.collect()) == [rows[i] for i in sorted(set(groups_of([r.text for r in rows])))]


def test_rough_rows(spark):
    docs = rough_documents(spark)
    got = near_copies.one_per_group(docs)
    assert got.columns == docs.columns
    assert got.count() == len(set(groups_of([r.text for r in docs.collect()])))


def test_empty_table(spark):
    assert near_copies.one_per_group(no_documents(spark)).count() == 0
