"""A counterfactual-regularised toxicity classifier.

A text is described by which words it has, and by the first letters of its words, so
that inflected forms share a feature. Features that tell the labels apart are chosen
from counts over the labelled sample, and a logistic regression is fitted on them by
accelerated gradient descent. In every labelled text that mentions a group of people,
the mention is swapped for another group, and for none, and the differences between the
scores of the text and its counterfactuals are penalised. Texts that mention none, of either
label, are made to: a bounded number of them is trained on again with a mention put in,
groups taking turns, and paired with the same text with another group, and with none. So a
mention as such moves no score, also where the labelled texts mention few groups or one
group mostly in toxic ones.

Training is on a bounded sample of labelled rows, features and counts by Spark; scoring
covers every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, text_of
from quern.sources import write_through

#: At most so many labelled documents, and of them so many features, train the model; texts
#: of more characters are scored, but not trained on.
SAMPLE = 10_000
FEATURES = 4_000
LONGEST = 200_000

#: Labelled texts that a mention is put into, about, at most.
PUT_IN = 2_000

#: A text with at least this score is predicted to be toxic.
THRESHOLD = 0.3

#: A feature is used if its log odds between labels are at least so large, and so many
#: standard errors from zero.
LEAST_ODDS = 1.0
LEAST_ERRORS = 3.0

#: Strength of the penalty on score changes, and of that on large weights.
COUNTERFACTUAL = 4.0
RIDGE = 1e-3

#: Letters of the word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6)

# Names of groups of people by language, each line of one kind.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys", "transgender"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "lesbian", "straight", "bisexual", "queer"],
    ["black", "white", "asian", "latino", "indigenous"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "buddhisten"],
    ["ausländer", "flüchtlinge", "einwanderer"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "hindous"],
    ["étrangers", "réfugiés", "immigrés"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos", "hindúes"],
    ["extranjeros", "refugiados", "inmigrantes"],
]

_OTHER = {
    term: group[(i + 1) % len(group)]
    for group in IDENTITY_TERMS
    for i, term in enumerate(group)
}
_TERMS = sorted(_OTHER)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings where it is longer (marked by a hyphen)."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def swapped(words: set[str]) -> set[str]:
    """The words with every mention of a group swapped for another of its kind."""
    return {_OTHER.get(w, w) for w in words}


def _feature_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        names, labels = [], []
        for text, label in zip(frame["text"], frame["label"]):
            own = {f for w in words_of(text) for f in features_of(w)}
            names += own
            labels += [label] * len(own)
        yield pd.DataFrame({"feature": names, "label": labels})


def counterfactuals(text: str, every: int) -> tuple[set[str], set[str], list[set[str]]]:
    """The words of a text, those that are trained on, and their counterfactuals.

    Of texts without a mention of a group, one in ``every``, by a checksum, gets one put in;
    with it the text is a labelled one of its own.
    """
    words = words_of(text)
    if not words.isdisjoint(_OTHER):
        return words, words, [swapped(words), words - _OTHER.keys()]
    turn = zlib.crc32(text.encode())
    if turn % every:
        return words, words, []
    term = _TERMS[turn // every % len(_TERMS)]
    return words, words | {term}, [words | {_OTHER[term]}, words]


def _indexed(number: dict[str, int], every: int):
    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ids(words: set[str]) -> list[int]:
            found = {f for w in words for f in features_of(w)}
            return sorted(number[f] for f in found if f in number)

        for frame in frames:
            out = []
            for text, label in zip(frame["text"], frame["label"]):
                words, named, others = counterfactuals(text, every)
                out.append((label, ids(named), [ids(o) for o in others]))
                if named != words:
                    out.append((label, ids(words), []))
            yield pd.DataFrame(out, columns=["label", "ids", "others"])

    return over


def _sums(weights: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights[cols], n)


def fit_weights(
    labels: np.ndarray,
    own: list[list[int]],
    others: list[list[list[int]]],
    features: int,
    steps: int = 300,
    counterfactual: float = COUNTERFACTUAL,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss plus both penalties."""
    n = max(1, len(labels))
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    cols = np.array([i for x in own for i in x], dtype=np.int64)
    pairs = [(a, b) for a, more in zip(own, others) for b in more]
    # Of a pair only what differs moves its score: features gained and lost.
    change = [[(i, 1.0) for i in set(b) - set(a)] + [(i, -1.0) for i in set(a) - set(b)] for a, b in pairs]
    pair_rows = np.repeat(np.arange(len(change)), [len(x) for x in change])
    pair_cols = np.array([i for x in change for i, _ in x], dtype=np.int64)
    pair_sign = np.array([s for x in change for _, s in x])
    weights = np.zeros(features)
    rate = labels.mean() if len(labels) else 0.0
    bias = math.log((rate + 1e-3) / (1 - rate + 1e-3))
    ahead, ahead_bias = weights.copy(), bias
    # The traces of the curvatures bound how fast the slope can change; the penalty on score
    # changes only bends the features that differ within a pair.
    bound = np.full(features, (len(cols) / n + 1.0) / 4.0 + RIDGE)
    bias_step = 1.0 / bound[0] if features else 1.0
    if pairs:
        bound[np.unique(pair_cols)] += 2.0 * counterfactual * max(1.0, len(pair_cols) / len(change))
    step = 1.0 / bound
    for i in range(steps):
        z = _sums(ahead, rows, cols, len(own)) + ahead_bias
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels
        slope = np.bincount(cols, error[rows], features) / n + RIDGE * ahead
        if pairs:
            gap = np.bincount(pair_rows, pair_sign * ahead[pair_cols], len(change))
            push = 2.0 * counterfactual / len(change) * gap[pair_rows] * pair_sign
            slope += np.bincount(pair_cols, push, features)
        new, new_bias = ahead - step * slope, ahead_bias - bias_step * error.sum() / n
        drift = i / (i + 3.0)
        ahead = new + drift * (new - weights)
        ahead_bias = new_bias + drift * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, float(bias)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    longest: int = LONGEST,
    put_in: int = PUT_IN,
    counterfactual: float = COUNTERFACTUAL,
) -> dict:
    """``{"weights": {feature: weight}, "bias": bias}`` from at most ``sample`` rows.

    ``labels (doc_id, toxic)``: rows with other labels than 0 and 1 are left out. The
    sample is chosen by a hash of the key; texts of more than ``longest`` characters are
    scored like any other, but not trained on. Of rows that repeat a key the one with the
    smallest text is trained on, once for each label the key has. About ``put_in`` of the
    texts are trained on with a mention as well (0: none). Without labels every score is
    one half.
    """
    marked = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("k"), F.col("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("k"), "k", "label")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").alias("k"), text_of().alias("text"))
    rows = write_through(
        texts.filter(F.length("text") <= longest)
        .join(F.broadcast(marked.distinct()), "k")
        .groupBy("k", "label")
        .agg(F.min("text").alias("text"))
        .select("text", "label")
    )
    total, toxic = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total:
        return {"weights": {}, "bias": 0.0}
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a / (toxic + 1.0 - a)) - F.log(b / (total - toxic + 1.0 - b))
    error = F.sqrt(1.0 / a + 1.0 / b)
    chosen = (
        rows.mapInPandas(_feature_rows, "feature string, label int")
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("a"))
        .filter(F.col("n") > 2)
        .withColumn("odds", odds)
        .withColumn("errors", F.abs("odds") / error)
        .filter((F.abs("odds") >= LEAST_ODDS) & (F.col("errors") >= LEAST_ERRORS))
        .orderBy(F.desc("errors"), "feature")
        .limit(FEATURES)
        .collect()
    )
    named = dict.fromkeys([r["feature"] for r in chosen])
    for term in _OTHER:
        named.update(dict.fromkeys(features_of(term)))
    number = {f: i for i, f in enumerate(named)}
    every = -(-total // put_in) if put_in else 1 << 33  # beyond any checksum but zero
    step = _indexed(number, every)
    got = rows.mapInPandas(step, "label int, ids array<int>, others array<array<int>>").collect()
    got.sort(key=lambda r: (r["label"], r["ids"], r["others"]))
    weights, bias = fit_weights(
        np.array([r["label"] for r in got], dtype=float),
        [r["ids"] for r in got],
        [r["others"] for r in got],
        len(number),
        counterfactual=counterfactual,
    )
    return {"weights": {f: float(weights[i]) for f, i in number.items() if weights[i]}, "bias": bias}


def scores(text: Column, model: dict) -> Column:
    """The score of every text, 0 to 1; a null or empty text has the bias's score."""
    weights, bias = model["weights"], model["bias"]

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}
        out = []
        for text in texts:
            found: set[str] = set()
            for word in words_of(text):
                hits = known.get(word)
                if hits is None:
                    hits = [f for f in features_of(word) if f in weights]
                    if len(known) < 200_000:
                        known[word] = hits
                if hits:
                    found.update(hits)
            z = bias + sum(weights[f] for f in sorted(found))
            out.append(1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z)))))
        return pd.Series(out, dtype="float64")

    return of(text)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from: a quarter, by a checksum of the key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<key>, held_out, score, predicted)`` of every row of ``docs``.

    Equal texts have equal scores. Rows without a key are scored and not held out.
    """
    rows = docs.select(
        F.col(key), held_out(key).alias("held_out"), scores(text_of(text), model).alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, by a model of the labels outside the held-out quarter."""
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~held_out())
    return scored(docs, fit(docs, labels))


QUERIES = {"op2_counterfactual_toxicity": op2_counterfactual_toxicity}
SQL: dict[str, str] = {}
