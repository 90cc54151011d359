"""Quality rules: base counts, and lines labelled by a linear-chain CRF.

Every line with a word is content or boilerplate. A conditional random field scores a
labelling by what each line looks like (feature weights) and by which label follows
which (transition weights); Viterbi decoding finds the best labelling, and the share
of a text's word characters on content lines decides whether the text is kept.

The field is trained here, by gradient ascent on the conditional log-likelihood
(forward-backward), on a bounded sample of labelled documents. Labels are by document, and
lines change label within one: so runs of lines of documents with one label are spliced into
documents with the other, which makes chains whose every line has a label of its own. A
Gaussian prior around stated weights keeps a field that has seen few labels sensible;
without labels the prior is the field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, text_of

#: At most so many labelled documents train the field, each with a run of at most so many
#: of its lines, whose place is chosen by a hash.
SAMPLE = 4_000
LINES = 200

#: Runs of lines that are spliced into a document at most, and lines of a run.
SPLICES = 3
SPLICED_LINES = 8

#: A text is kept if at least this share of its word characters is on content lines.
CONTENT_SHARE = 0.5

#: Base rules, in percent where a share.
MIN_WORDS = 10
MAX_REPEATED = 20
WINDOW = 5

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")

#: Features of a line, each between 0 and 1, and the prior of their weights for content.
PRIOR = {
    "bias": 1.0,
    "symbols a word": -4.0,
    "words with a symbol": -4.0,
    "upper-case share": -3.0,
    "words ending in !!": -3.0,
    "digits share": -1.0,
    "ends a sentence": 0.5,
    "very short": -0.3,
    "long": 0.5,
    "repeats a line": -2.0,
    "repeats words": -1.0,
}
#: Prior of the weight for a label to stay the same from one line to the next.
STAY = 0.5

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, content_share double"
)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    # Windows get numbers, exactly: those of one word more from those of one less.
    code = ids
    for extra in range(1, window):
        pair = code[: len(words) - extra] * len(number) + ids[extra:]
        code = np.unique(pair, return_inverse=True)[1]
    counts = np.bincount(code)
    twice = counts[code] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def lines_of(text: str) -> tuple[list[list[str]], list[str]]:
    """The words of each line that has any, and those lines."""
    words, lines = [], []
    for line in text.split("\n"):
        found = _WORD.findall(line)
        if found:
            words.append(found)
            lines.append(line)
    return words, lines


def features(words: list[list[str]], lines: list[str]) -> np.ndarray:
    """One row per line, columns as in :data:`PRIOR`."""
    out = np.zeros((len(lines), len(PRIOR)), dtype=np.float64)
    seen: set[str] = set()
    for i, (found, line) in enumerate(zip(words, lines)):
        n, size = len(found), len(line)
        symbols = len(_SYMBOL.findall(line))
        upper = line.isupper()
        out[i] = (
            1.0,
            min(1.0, symbols / n / 2),
            min(1.0, sum(1 for w in found if _SYMBOL.search(w)) / n) if symbols else 0.0,
            1.0 if upper and n > 2 else 0.0,
            min(1.0, line.count("!!") / n),
            min(1.0, sum(map(line.count, "0123456789")) / size),
            1.0 if line.rstrip()[-1:] in ".?!" else 0.0,
            1.0 if n < 3 else 0.0,
            1.0 if n > 15 else 0.0,
            1.0 if line in seen else 0.0,
            1.0 - len(set(found)) / n if n > 9 else 0.0,
        )
        seen.add(line)
    return out


def viterbi(scores: np.ndarray, stay: float) -> np.ndarray:
    """The best labelling: True for content. ``scores``: content over boilerplate."""
    n = len(scores)
    came_from = np.zeros((n, 2), dtype=np.int8)
    bad, good = 0.0, 0.0
    values = scores.tolist()
    for i, s in enumerate(values):
        if i == 0:
            good = s
            continue
        to_bad, to_good = int(good > bad + stay), int(good + stay >= bad)
        came_from[i] = (to_bad, to_good)
        bad, good = (
            max(bad + stay, good),
            max(good + stay, bad) + s,
        )
    out = np.zeros(n, dtype=bool)
    state = int(good >= bad)
    for i in range(n - 1, -1, -1):
        out[i] = bool(state)
        state = int(came_from[i, state])
    return out


def spliced(
    chains: list[np.ndarray], labels: list[int], seed: int = 1
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Every document's chain with its label, and again with runs of the other label's lines.

    Equal documents in equal order give equal chains.
    """
    random = np.random.default_rng(seed)
    of = {y: [x for x, z in zip(chains, labels) if z == y and len(x)] for y in (0, 1)}
    out, wanted = [], []
    for x, y in zip(chains, labels):
        if not len(x):
            continue
        out.append(x)
        wanted.append(np.full(len(x), y))
        others = of[1 - y]
        if not others:
            continue
        parts, told = [x], [np.full(len(x), y)]
        for _ in range(random.integers(1, SPLICES + 1)):
            other = others[random.integers(len(others))]
            size = random.integers(1, min(len(other), SPLICED_LINES) + 1)
            start = random.integers(0, len(other) - size + 1)
            i = random.integers(len(parts))  # into one of the parts so far
            at = random.integers(0, len(parts[i]) + 1)
            run, mark = other[start : start + size], np.full(size, 1 - y)
            parts[i : i + 1] = [parts[i][:at], run, parts[i][at:]]
            told[i : i + 1] = [told[i][:at], mark, told[i][at:]]
        out.append(np.concatenate(parts))
        wanted.append(np.concatenate(told))
    return out, wanted


def train(chains: list[np.ndarray], wanted: list[np.ndarray], steps: int = 100) -> dict:
    """Weights of the field: ``{"emit": one per feature, "stay": transition}``.

    ``chains``: features of the lines of a document, one row each; ``wanted``: their labels.
    """
    prior = np.array([*PRIOR.values(), STAY])
    weights = prior.copy()
    if not chains:
        return {"emit": weights[:-1].tolist(), "stay": float(weights[-1])}
    # Chains of like length are summed over side by side.
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    groups = [order[i : i + 256] for i in range(0, len(order), 256)]
    packs = []
    for group in groups:
        width = len(chains[group[-1]])
        x = np.zeros((len(group), width, len(PRIOR)))
        y = np.zeros((len(group), width), dtype=int)
        real = np.zeros((len(group), width), dtype=bool)
        for r, i in enumerate(group):
            x[r, : len(chains[i])], y[r, : len(chains[i])] = chains[i], wanted[i]
            real[r, : len(chains[i])] = True
        packs.append((x, y, real))
    total = sum(int(p[2].sum()) for p in packs)
    momentum = np.zeros_like(weights)
    for step in range(steps):
        slope = (prior - weights) * 5.0
        for x, y, real in packs:
            slope += _slope(x, y, real, weights)
        momentum = 0.9 * momentum + slope / total
        weights = weights + 0.5 * momentum
    return {"emit": weights[:-1].tolist(), "stay": float(weights[-1])}


def _slope(x, y, real, weights) -> np.ndarray:
    """Observed less expected feature counts, by forward and backward sums."""
    emit, stay = x @ weights[:-1], weights[-1]
    rows, width = emit.shape
    node = np.stack([np.zeros_like(emit), emit], axis=2)
    move = np.array([[stay, 0.0], [0.0, stay]])
    ahead = np.zeros((rows, width, 2))
    ahead[:, 0] = node[:, 0]
    for i in range(1, width):
        come = np.logaddexp.reduce(ahead[:, i - 1, :, None] + move, axis=1) + node[:, i]
        ahead[:, i] = np.where(real[:, i, None], come, ahead[:, i - 1])
    behind = np.zeros((rows, width, 2))
    for i in range(width - 2, -1, -1):
        back = np.logaddexp.reduce(move + (node[:, i + 1] + behind[:, i + 1])[:, None, :], axis=2)
        behind[:, i] = np.where(real[:, i + 1, None], back, behind[:, i + 1])
    norm = np.logaddexp.reduce(ahead[:, -1], axis=1)
    content = np.exp(ahead[:, :, 1] + behind[:, :, 1] - norm[:, None]) * real
    slope = np.einsum("rwf,rw->f", x, (y - content) * real)
    both = real[:, 1:]
    same = (y[:, 1:] == y[:, :-1]) & both
    pair = ahead[:, :-1, :, None] + move + (node[:, 1:] + behind[:, 1:])[:, :, None, :]
    pair = np.exp(pair - norm[:, None, None, None])
    expected = (pair[:, :, 0, 0] + pair[:, :, 1, 1]) * both
    return np.append(slope, same.sum() - expected.sum())


def _chain_rows(most: int):
    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for mark, label, text in zip(frame["h"], frame["y"], frame["t"]):
                x = features(*lines_of(text))  # of the whole text
                start = mark % max(1, len(x) - most + 1)
                out.append((mark, label, x[start : start + most].astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["h", "y", "x"])

    return over


def training_chains(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES
) -> tuple[list, list]:
    """Features of the lines of at most ``sample`` labelled documents, and their labels.

    Documents are chosen by a hash of their key. Of rows that repeat a key the one with the
    smallest text is taken, once for each label the key has. Labels other than 0 and 1 and
    labels of no document are left out. The driver gets numbers only, at most ``lines``
    rows of a document.
    """
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("k"), F.col("quality").cast("int").alias("y"))
        .distinct()
        .orderBy(F.xxhash64("k"), "k", "y")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").alias("k"), text_of().alias("t"))
    rows = texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    rows = rows.select(F.xxhash64("k").alias("h"), "y", "t")
    got = rows.mapInPandas(_chain_rows(lines), "h long, y int, x binary").collect()
    got.sort(key=lambda r: (r["h"], r["y"], bytes(r["x"])))
    chains = [np.frombuffer(r["x"], dtype="<f4").reshape(-1, len(PRIOR)).astype(float) for r in got]
    return chains, [r["y"] for r in got]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The field for at most ``sample`` documents of :func:`training_chains`, spliced.

    No label at all gives the prior weights.
    """
    return train(*spliced(*training_chains(docs, labels, sample)))


def measured(text: Column, weights: dict) -> Column:
    """A struct of :data:`FIELDS` for each text, from whole texts."""
    emit, stay = np.array(weights["emit"]), weights["stay"]

    @F.pandas_udf(FIELDS)
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words, lines = lines_of(text)
            flat = [w for line in words for w in line]
            chars = sum(map(len, flat))
            share = 0.0
            if lines:
                content = viterbi(features(words, lines) @ emit, stay)
                sizes = np.array([sum(map(len, line)) for line in words])
                share = float(sizes[content].sum() / chars)
            out.append(
                (
                    len(flat),
                    chars,
                    len(_SYMBOL.findall(text)),
                    len(lines) - len(set(lines)),
                    repeated_words(flat),
                    share,
                )
            )
        return pd.DataFrame(out, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return of(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (
        100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"]
    )


def verdicts(
    docs: DataFrame, weights: dict, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Counts, content share and verdict of every row of ``docs``.

    A null or empty text, or one of white space only, has no words, content share 0, and
    fails the base rules. Repeated rows are judged as often as they come.
    """
    m = F.col("_m")
    names = [f.split()[0] for f in FIELDS.split(", ")]
    rows = docs.select(F.col(key).alias("_k"), measured(text_of(text), weights).alias("_m"))
    failed = base_failed(m)
    return rows.select(
        F.col("_k").alias(key),
        *(m[n].alias(n) for n in names),
        failed.alias("base_failed"),
        (~failed & (m["content_share"] >= CONTENT_SHARE)).alias("kept"),
    )


def only_kept(docs: DataFrame, weights: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged."""
    m = measured(text_of(text), weights)
    return docs.filter(~base_failed(m) & (m["content_share"] >= CONTENT_SHARE))


def op4_line_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return verdicts(docs, fit(docs, labels))


QUERIES = {"op4_line_quality_rules": op4_line_quality_rules}
SQL: dict[str, str] = {}
