"""Fill-in-the-middle texts, cut by a learned index of token boundaries.

A text of ``n`` tokens has ``n + 1`` boundaries, and a cut is given by its rank among
them. The boundaries' offsets are nearly a straight line over their ranks, so the index
learns the line: as few pieces as a greedy cone finds whose predictions are all off by at
most :data:`ERROR` characters. What each prediction is off by is kept in one byte a
boundary. A cut is found by its piece's prediction, corrected by that byte, which is
exact; the offsets themselves are not kept.

Texts are indexed in stretches of :data:`STRETCH` characters, so that beside the text and
its bytes no memory grows with a text's length. Rows are independent: no shuffle.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, text_of

#: Characters that a prediction may be off by. Rounding adds one; a byte must hold it.
ERROR = 48
STRETCH = 1 << 20

#: Offsets that a piece is first tried on; each further try takes twice as many.
FIRST_TRY = 256
MOST_TRIED = 1 << 16

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 of those so many begin with the suffix.
TRANSFORMED = 90
SUFFIX_FIRST = 20
SEED = 1


def ends(text: str) -> Iterator[np.ndarray]:
    """The offsets at which tokens ``[A-Za-z]+|[^A-Za-z]`` end, a stretch at a time."""
    for start in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[start : start + STRETCH + 1].encode("utf-32-le"), dtype="<u4")
        letter = (codes | 32) - np.uint32(97) < 26  # wraps around below "a"
        end = ~letter
        end[:-1] |= ~letter[1:]
        if start + STRETCH >= len(text):
            end[-1] = True
        else:
            end = end[:-1]
        if end.any():  # none within a run of letters
            yield np.flatnonzero(end) + (start + 1)


def pieces(offsets: np.ndarray, error: int = ERROR) -> Iterator[tuple[int, float]]:
    """First place and slope of each piece; lines go through a piece's first offset.

    A piece takes in offsets as long as some slope is within ``error`` of all of them.
    """
    first, n = 0, len(offsets)
    while first < n:
        low, high, to, tried = -math.inf, math.inf, first + 1, FIRST_TRY
        while to < n:
            stop = min(n, to + tried)
            run = np.arange(to - first, stop - first)
            rise = offsets[to:stop] - offsets[first]
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            fits = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else len(run)
            if fits:
                low, high, to = float(lows[fits - 1]), float(highs[fits - 1]), to + fits
            if fits < len(run):
                break
            tried = min(2 * tried, MOST_TRIED)
        yield first, (low + high) / 2 if math.isfinite(low) else 0.0
        first = to


class RankIndex:
    """Offset of each token boundary of a text, by rank: 0 the start, ``n`` the end."""

    def __init__(self, text: str, error: int = ERROR) -> None:
        if not 0 <= error < 127:
            raise ValueError("a byte must hold what a prediction is off by")
        self.ranks, self.origins, self.slopes = [], [], []
        off, rank = [], 1
        for offsets in ends(text):
            starts = []
            for first, slope in pieces(offsets, error):
                starts.append(first)
                self.ranks.append(rank + first)
                self.origins.append(int(offsets[first]))
                self.slopes.append(slope)
            starts = np.array(starts)
            piece = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(offsets)))
            slope = np.array(self.slopes[-len(starts) :])[piece]
            line = offsets[starts][piece] + np.floor(slope * (np.arange(len(offsets)) - starts[piece]))
            off.append((offsets - line).astype(np.int8))
            rank += len(offsets)
        self.n = rank - 1
        self.off = np.concatenate(off) if off else np.zeros(0, dtype=np.int8)

    def offset(self, rank: int) -> int:
        if rank == 0:
            return 0
        piece = bisect_right(self.ranks, rank) - 1
        line = self.origins[piece] + math.floor(self.slopes[piece] * (rank - self.ranks[piece]))
        return line + int(self.off[rank - 1])


def _hash_part(digest: Column, place: int) -> Column:
    """The ``place``-th eight hexadecimal digits of a hash, as a number."""
    return F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("long")


def _cuts(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Tokens, and the offsets of the two cuts that the hashes choose among the boundaries."""
    out = []
    for t, x, y in zip(text, a, b):
        index = RankIndex(t)
        first, last = sorted((int(x) % (index.n + 1), int(y) % (index.n + 1)))
        out.append((index.n, index.offset(first), index.offset(last)))
    return pd.DataFrame(out, columns=["n", "first", "last"])


def transformed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED
) -> DataFrame:
    """``(key, n, form, prefix_chars, middle_chars, text, output)`` of every row of ``docs``.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle), chosen
    like the cuts by a hash of seed and key, so reruns agree and equal keys get equal hashes.
    A null text is empty, and a null key is hashed as an empty one. Empty texts, and those
    that contain a mark, stay plain, with null counts of characters. Repeated rows are
    returned as often as they come, an empty table gives an empty result, and columns other
    than key and text play no part.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(key).alias("_k"), text_of(text).alias("_t"), digest.alias("_h"))
    cuts = F.pandas_udf(_cuts, "n long, first int, last int")
    cuts = cuts("_t", _hash_part(F.col("_h"), 0), _hash_part(F.col("_h"), 1))
    rows = rows.select("_k", "_t", "_h", cuts.alias("_c"))
    t, first, last = F.col("_t"), F.col("_c.first"), F.col("_c.last")
    plain = (
        (t == "")
        | t.contains(PREFIX)
        | t.contains(SUFFIX)
        | t.contains(MIDDLE)
        | (_hash_part(F.col("_h"), 2) % 100 >= TRANSFORMED)
    )
    spm = _hash_part(F.col("_h"), 3) % 100 < SUFFIX_FIRST
    form = F.when(plain, "plain").when(spm, "spm").otherwise("psm")
    begin = F.concat(F.lit(PREFIX), F.substring(t, F.lit(1), first))
    middle = F.concat(F.lit(MIDDLE), F.substring(t, first + 1, last - first))
    end = F.concat(F.lit(SUFFIX), F.substring(t, last + 1, F.length(t) - last))
    output = (
        F.when(F.col("form") == "plain", t)
        .when(F.col("form") == "spm", F.concat(end, begin, middle))
        .otherwise(F.concat(begin, end, middle))
    )
    cut = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        F.col("_k").alias(key),
        F.col("_c.n").alias("n"),
        "form",
        F.when(cut, first.cast("long")).alias("prefix_chars"),
        F.when(cut, (last - first).cast("long")).alias("middle_chars"),
        t.alias(text),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Marks part it, as no such text contains one."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "plain", output)
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(F.concat(parts[1], parts[3], parts[2]))
    )


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Cuts and form of every document, and hashes of the output and of the text rebuilt."""
    rows = transformed(documents(spark, folder))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
SQL = {
    "op11_fill_in_middle": r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), chosen AS (
  SELECT doc_id, t, tokens, len(tokens) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(tokens) + 1) AS a,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(tokens) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm'
              ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT doc_id, t, n, form,
         coalesce(array_to_string(tokens[1:least(a, b)], ''), '') AS prefix,
         coalesce(array_to_string(tokens[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
         coalesce(array_to_string(tokens[greatest(a, b) + 1:n], ''), '') AS suffix
  FROM chosen
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
}
