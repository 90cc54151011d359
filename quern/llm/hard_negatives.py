"""Hard negatives: rows of other labels whose score is near, but below, a positive's.

A row's score is its inner product with an anchor. A positive at ``p`` asks for the best
negatives with ``30 p <= 100 score <= 90 p``; the windows of one anchor's positives overlap.
Their upper limits part the scores into disjoint slots, so each negative is looked at once:
the first ``k`` of every slot are kept where the scores are made, and again where those of
one slot meet. A positive's answer is the first ``k`` of its own slot and all lower ones,
merged in descending order, down to its lower limit.

Rows are dealt to blocks of a bounded size by a hash, whatever their labels, and every
anchor goes once to every block. A task holds one block of rows, past which the anchors
stream; what leaves it is at most ``k`` rows for each anchor and slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources import write_through

POSITIVES = 5
NEGATIVES = 10
#: A negative's score is within these shares, in percent, of the positive's.
LOWEST, HIGHEST = 30, 90

#: Components are rounded down to so many parts of one.
SCALE = 256

#: Rows of a block, at most on average, and at least if there are few.
BLOCK = 65_536
LEAST_BLOCK = 1_024
#: Scores that are held at once.
SCORES = 4_000_000

#: Scores beyond this, either way, count as this.
LIMIT = 2**62


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, exact, within :data:`LIMIT`."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = a @ b.T
        most = np.outer(np.abs(a).max(axis=1, initial=0), np.abs(b).max(axis=1, initial=0))
        wide = most * a.shape[1] >= 2.0**53  # a double may not be exact
    out[wide] = 0
    out = out.astype(np.int64)
    for i, j in np.argwhere(wide):
        exact = sum(int(x) * int(y) for x, y in zip(a[i], b[j]))
        out[i, j] = min(max(exact, -LIMIT), LIMIT)
    return out


def _vectors(column: pa.ListArray, width: int) -> np.ndarray:
    """One row each, rounded down, shorter ones ended with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _width(column: pa.ListArray) -> int:
    return int(np.diff(column.offsets.to_numpy()).max(initial=0))


class _Block:
    """The rows of a block, in order of their ids, nulls last."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        rows = rows.sort_by([("id", "ascending"), ("rid", "ascending")])
        self.rids = rows["rid"].to_numpy()
        self.ids = rows["id"].combine_chunks()
        self.labels = rows["label"].to_numpy()
        self.vectors = rows["vector"].combine_chunks()
        if isinstance(self.vectors, pa.ChunkedArray):
            self.vectors = self.vectors.chunk(0)
        self.width = _width(self.vectors)

    def best(self, anchors: pa.RecordBatch, k: int, same: bool) -> Iterator[tuple]:
        """``(anchor, slot, place, score)`` of the first ``k`` rows of each anchor's slots."""
        own = anchors["label"].to_numpy(zero_copy_only=False)
        rids = anchors["rid"].to_numpy()
        lows, highs = anchors["lows"].to_pylist(), anchors["highs"].to_pylist()
        width = max(self.width, _width(anchors["vector"]))
        vectors, ours = _vectors(anchors["vector"], width), _vectors(self.vectors, width)
        for label in np.unique(own):
            places = np.flatnonzero((self.labels == label) == same)
            if not len(places):
                continue
            theirs, mine = ours[places], np.flatnonzero(own == label)
            step = max(1, SCORES // len(places))
            for start in range(0, len(mine), step):
                some = mine[start : start + step]
                for i, row in zip(some, scores(vectors[some], theirs)):
                    for slot, (low, high) in enumerate(zip(lows[i], highs[i])):
                        at = np.flatnonzero((row >= low) & (row <= high))
                        if same:
                            at = at[self.rids[places[at]] != rids[i]]
                        if len(at) > k:
                            kth = np.partition(row[at], len(at) - k)[len(at) - k]
                            at = at[row[at] >= kth]
                        # Rows are in order of ids, and stay so where scores are equal.
                        for j in at[np.argsort(-row[at], kind="stable")[:k]]:
                            yield rids[i], slot, places[j], row[j]


FOUND = "anchor long, slot int, rid long, id long, score long"


def _searched(k: int, same: bool):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        block, number = None, None
        for batch in batches:
            numbers = batch["block"].to_numpy()
            kinds = batch["is_anchor"].to_numpy(zero_copy_only=False)
            change = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *change], [*change, len(batch)]):
                part = batch.slice(a, b - a)
                if numbers[a] != number:
                    rows, block, number = [], None, numbers[a]
                if not kinds[a]:
                    rows.append(part)
                    continue
                if block is None and rows:
                    block, rows = _Block(rows), []
                found = list(block.best(part, k, same)) if block else []
                if found:
                    anchors, slots, places, values = map(np.array, zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchors, pa.int64()),
                            pa.array(slots, pa.int32()),
                            pa.array(block.rids[places], pa.int64()),
                            block.ids.take(pa.array(places)).cast(pa.int64()),
                            pa.array(values, pa.int64()),
                        ],
                        names=["anchor", "slot", "rid", "id", "score"],
                    )

    return over


def first_of_slots(
    rows: DataFrame, anchors: DataFrame, blocks: int, k: int, same: bool
) -> DataFrame:
    """``(anchor, slot, rid, id, score)``: the first ``k`` rows of every slot of an anchor.

    ``anchors`` are rows with ``lows`` and ``highs``, the inclusive bounds of their slots.
    Rows are of the anchor's own label (and not the anchor) or of others. Higher scores come
    first, then smaller ids, nulls last.
    """
    bounds = "array<long>"
    blocked = rows.select(
        F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(False).alias("is_anchor"),
        "rid",
        "id",
        "label",
        "vector",
        F.lit(None).cast(bounds).alias("lows"),
        F.lit(None).cast(bounds).alias("highs"),
    )
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(True).alias("is_anchor"),
        "rid",
        "id",
        "label",
        "vector",
        "lows",
        "highs",
    )
    both = blocked.unionByName(asked).repartitionById(blocks, "block")
    found = both.sortWithinPartitions("block", "is_anchor", "label").mapInArrow(
        _searched(k, same), FOUND
    )
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("rid")]
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def share(p: Column, percent: int, up: bool) -> Column:
    """``percent`` of whole numbers, rounded up or down, without going beyond a long."""
    rest = F.pmod(p, F.lit(100))
    part = rest * percent + (99 if up else 0)
    whole = F.floor((p - rest) / F.lit(100).cast("decimal(3,0)")).cast("long")
    return whole * percent + F.floor(part / 100)


def labelled(rows: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """``(rid, id, label, vector)`` of the rows that take part, written, numbered as written.

    Rows without a label or vector, or with a component that is null, NaN or infinite, do not.
    """
    good = F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    )
    part = rows.select(F.col(key).cast("long").alias("id"), label.alias("label"), F.col(vector).alias("vector"))
    part = part.filter(F.col("label").isNotNull() & F.col("vector").isNotNull())
    return write_through(part.filter(good.alias("good")).withColumn("rid", F.monotonically_increasing_id()))


def mined(
    embeddings: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: Column | None = None,
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` tells anchors by the column ``id``, the row's key as a long. Rows that
    repeat are rows of their own: an anchor's copy may be its positive, and copies of an
    anchor each have results. Null ids are no anchors of the query below and come last among
    equal scores. Vectors of different lengths are compared as if the shorter ended with
    zeros; scores beyond 2^62 count as 2^62. An anchor without positives, or a positive
    without negatives in its window (also one with a negative score, whose window is empty),
    has no rows. An empty table gives an empty result; other columns play no part.
    """
    rows = labelled(embeddings, key, F.col("label") if label is None else label, vector)
    total = rows.count()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-total // BLOCK), min(parts, total // LEAST_BLOCK))
    anchors = rows.filter(is_anchor)
    everything = anchors.withColumn("lows", F.array(F.lit(-LIMIT)))
    everything = everything.withColumn("highs", F.array(F.lit(LIMIT)))
    near = first_of_slots(rows, everything, blocks, positives, same=True).select(
        "anchor",
        F.col("rank").alias("place"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        share(F.col("score"), LOWEST, up=True).alias("low"),
        share(F.col("score"), HIGHEST, up=False).alias("high"),
    )
    # A few rows for each anchor from here on, but for the search.
    windows = write_through(near.filter(F.col("low") <= F.col("high")))
    limits = windows.groupBy("anchor", "high").agg(F.min("low").alias("low"))
    down = Window.partitionBy("anchor").orderBy(F.desc("high"))
    below = F.coalesce(F.lead("high").over(down) + 1, F.col("low"))
    slots = limits.select(
        "anchor",
        "high",
        F.greatest(below, F.col("low")).alias("low"),
        (F.row_number().over(down) - 1).alias("slot"),
    )
    bounds = F.sort_array(F.collect_list(F.struct("slot", "low", "high")))
    bounds = slots.groupBy("anchor").agg(bounds.alias("b"))
    bounds = bounds.select(
        F.col("anchor").alias("rid"), F.col("b.low").alias("lows"), F.col("b.high").alias("highs")
    )
    kept = first_of_slots(rows, anchors.join(bounds, "rid"), blocks, negatives, same=False)
    asked = windows.join(slots.select("anchor", "high", F.col("slot").alias("top")), ["anchor", "high"])
    merged = asked.join(kept.drop("rank"), "anchor").filter(
        (F.col("slot") >= F.col("top")) & (F.col("score") >= F.col("low"))
    )
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("rid")]
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))
    names = anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        merged.withColumn("rank", rank)
        .filter(F.col("rank") <= negatives)
        .join(names, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Negatives of every row whose id is divisible by 100, by its five nearest positives."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows, F.col("id") % 100 == 0, label=moved)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {
    "op13_hard_negatives": r"""
WITH rows_in AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_in a, rows_in b
  WHERE a.vec_id % 100 = 0 AND a.rid <> b.rid
), positives AS (
  SELECT anchor, anchor_id, rid AS positive, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, rid) <= 5
), asked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score,
         n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.positive
                            ORDER BY n.score DESC, n.vec_id NULLS LAST, n.rid) AS place
  FROM positives p JOIN scored n ON p.anchor = n.anchor
  WHERE NOT n.same AND 30 * p.positive_score <= 100 * n.score
    AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id,
       positive_score, negative_score
FROM asked WHERE place <= 10
"""
}
