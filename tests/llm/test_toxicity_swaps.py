"""Counterfactuals through whole texts: mentions are put in, swapped, and made neutral."""

from __future__ import annotations

import random

import pytest
from quern.llm import toxicity

PLAIN = "river stone garden window letter market winter summer bridge teacher music paper street harbour".split()
INSULTS = "vile rotten filthy stupid worthless".split()


def sentences(n, named, seed):
    """Labelled texts; the group ``muslims`` is named by ``named``, the shares by label."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 2
        words = [rng.choice(PLAIN) for _ in range(12)]
        if toxic and rng.random() < 0.75:
            words[rng.randrange(12)] = rng.choice(INSULTS)
        if rng.random() < named[toxic]:
            words.insert(rng.randrange(12), "muslims")
        rows.append((i, " ".join(words) + f" n{i}", toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    def of(rows):
        docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
        return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")

    return of


def neutral(term, n=60, seed=9):
    rng = random.Random(seed)
    return [" ".join([*(rng.choice(PLAIN) for _ in range(10)), term, f"m{i}"]) for i in range(n)]


def scored(spark, texts, model):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.score for r in toxicity.scored(table, model).orderBy("doc_id").collect()]


def test_a_group_named_mostly_in_toxic_texts(spark, tables):
    docs, labels = tables(sentences(600, (0.05, 0.6), 1))
    plain = toxicity.fit(docs, labels, put_in=0, counterfactual=0.0)
    fair = toxicity.fit(docs, labels)

    def change(model):
        named, other = scored(spark, neutral("muslims"), model), scored(spark, neutral("christians"), model)
        return sum(abs(a - b) for a, b in zip(named, other)) / len(named)

    assert change(plain) > 0.2 and change(fair) < 0.5 * change(plain)
    # Of neutral mentions, those called toxic; and what is toxic is still found.
    wrong = lambda model: sum(s >= toxicity.THRESHOLD for s in scored(spark, neutral("muslims"), model)) / 60
    assert wrong(plain) > 0.9 and wrong(fair) < wrong(plain)
    toxic = scored(spark, [t.replace("river", "rotten") + " filthy" for t in neutral("")], fair)
    calm = scored(spark, neutral(""), fair)
    assert min(toxic) > max(calm)


def test_no_text_names_a_group(spark, tables):
    docs, labels = tables(sentences(400, (0.0, 0.0), 2))
    model = toxicity.fit(docs, labels, put_in=400)
    # Every kind was trained on, with either label, and moves no score by much.
    named = [t for t in toxicity._TERMS if t in model["weights"]]
    assert len(named) > 0.8 * len(toxicity._TERMS)
    for term in ("women", "muslims", "juden", "gay"):
        gaps = [a - b for a, b in zip(scored(spark, neutral(term), model), scored(spark, neutral(""), model))]
        assert max(map(abs, gaps)) < 0.15
    assert not any(s >= 0.9 for s in scored(spark, neutral("women"), model))


def test_mentions_are_put_in_by_turns():
    made = [toxicity.counterfactuals(f"plain text {i}", 3) for i in range(3000)]
    made = [m for m in made if m[2]]
    assert 800 < len(made) < 1200
    for words, named, (other, none) in made:
        (term,), (come,) = named - words, other - words
        assert toxicity._OTHER[term] == come and none == words
    assert {next(iter(named - words)) for words, named, _ in made} == set(toxicity._TERMS)
    words, named, others = toxicity.counterfactuals("Women and men", 10**9)
    assert words == named == {"women", "and", "men"} and others == [{"men", "and", "girls"}, {"and"}]


def test_very_few_labels(spark, tables):
    docs, labels = tables(sentences(2, (0.0, 1.0), 3))
    model = toxicity.fit(docs, labels)
    assert all(0 <= s <= 1 for s in scored(spark, ["muslims", "", "vile"], model))
    one = toxicity.fit(docs, labels.filter("toxic = 1"))
    assert all(0 <= s <= 1 for s in scored(spark, ["muslims", "", "vile"], one))


def test_long_texts_are_not_trained_on(spark, tables):
    rows = sentences(60, (0.0, 0.0), 4)
    docs, labels = tables([*rows, (99, "vile " * 500, 0)])
    assert toxicity.fit(docs, labels, longest=1000) == toxicity.fit(*tables(rows))
