"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target of words. A source that weighs more than it can give is held
to a number of epochs and its excess shared out among the others, by weight. Over the
training time t from 0 to 1 a source's share changes: its density is
``1 + slope * (2t - 1)`` times its mean. The integral of that schedule is the source's
cumulative demand, ``G(t) = t + slope * (t^2 - t)``; inverting it gives the time at
which a source's next word is due. Every source is a stream of its documents in hashed
order, repeated; the place of a document in the stream gives its training position,
and sorting by position interleaves the sources as the curriculum asks.

Only DataFrame operations are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import ROW, WORD, documents, rows_in_structs, text_of
from quern.operators.ordered import in_chunks, with_running_sum
from quern.sources import write_through

#: Weights of the sources in order, repeating; slopes of their schedules likewise.
WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)

#: Words of the mix over words of the input, and the most epochs of one source.
FACTOR = 1.5
EPOCHS = 2


def _source_key(source: str) -> Column:
    """Sorts as the source by code point, nulls last; never null itself."""
    name = F.col(source).cast("string")
    return F.when(name.isNull(), F.lit("z")).otherwise(F.concat(F.lit("a"), name))


def targets(
    totals: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    slopes: tuple[float, ...] = SLOPES,
    factor: float = FACTOR,
    epochs: int = EPOCHS,
) -> DataFrame:
    """``(source_key, source_size, target, slope)`` from ``totals (source_key, source_size)``.

    Sources are numbered across range partitions, so that any number of them will do.
    Each round of sharing is one aggregate over the sources.
    """
    totals = write_through(totals)
    rows = totals.count()
    one = totals.withColumn("_one", F.lit(1).cast("long"))
    ranked = with_running_sum(
        in_chunks(one, [], ["source_key"], rows), [], ["source_key"], "_one", "_rank"
    )
    at = ((F.col("_rank") - 1) % len(weights)).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at + 1)
    cap = F.col("source_size") * F.lit(float(epochs))
    shared = write_through(
        ranked.select(
            "source_key",
            "source_size",
            cap.alias("cap"),
            pick([float(w) for w in weights]).alias("weight"),
            pick([float(s) for s in slopes]).alias("slope"),
        )
    )
    level = 0.0  # words a unit of weight gets
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        words, capped, open_weight = shared.agg(
            F.sum("source_size"),
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        if not open_weight:
            break
        raised = (factor * words - capped) / open_weight
        if raised <= level:
            break
        level = raised
    return shared.select(
        "source_key",
        "source_size",
        F.least("cap", F.col("weight") * F.lit(level)).alias("target"),
        "slope",
    )


def _placed(docs: DataFrame, key: str, text: str, source: str, extra: list[Column]) -> DataFrame:
    """``docs`` with its source's numbers and ``start``, its first word's place there.

    A source's rows are numbered within chunks of the hashed order, whose sums are then
    added up over the source: as many chunks as rows in one, so that neither grows
    faster than the square root of the table.
    """
    # Of the key and the text, so that rows without a key are spread as well.
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    digest = F.md5(F.concat(name, F.lit(" "), F.md5(text_of(text).cast("binary"))).cast("binary"))
    rows = docs.count()
    digits = max(1, math.ceil(math.log(max(rows, 1), 16) / 2))
    sized = docs.select(
        F.col(key).alias("id"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        _source_key(source).alias("source_key"),
        digest.alias("digest"),
        F.substring(digest, 1, digits).alias("chunk"),
        *extra,
    )
    if not extra:
        sized = write_through(sized)  # small; whole rows are rather read again
    sums = sized.groupBy("source_key", "chunk").agg(F.sum("size").alias("words"))
    sums = write_through(sums)
    plan = targets(
        sums.groupBy("source_key").agg(F.sum("words").alias("source_size"))
    )
    before = Window.partitionBy("source_key").orderBy("chunk")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "source_key", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")
    ).join(plan, "source_key")
    within = Window.partitionBy("source_key", "chunk").orderBy("digest", "id")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(within), F.lit(0))
    return (
        sized.withColumn("inside", inside)
        .join(sums, ["source_key", "chunk"])
        .withColumn("start", F.col("base") + F.col("inside"))
    )


def position(place: Column, target: Column, slope: Column) -> Column:
    """The training time, 0 to 1, at which the source's word ``place`` is due.

    Inverts ``G(t) = t + slope * (t^2 - t) = place / target``.
    """
    share = F.try_divide(place, target)
    lead = 1.0 - slope
    return 2.0 * share / (lead + F.sqrt(lead * lead + 4.0 * slope * share))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    epochs: int = EPOCHS,
) -> DataFrame:
    """What the mix takes of every row of ``docs``, in training order.

    ``(<key>, size, source_size, target, taken, positions)``; ``positions`` has the
    training position of each copy the mix uses, and is empty for a row of which it
    takes nothing (which includes every text without words). A source's words taken add
    up to its target, rounded down: its last copy is taken in part where the target
    falls inside it. Null texts have size 0; rows without a source are a source of their
    own, the last; rows with equal keys are told apart by their texts, and equal rows
    are interchangeable. The order is of hashes of keys and texts, so reruns agree. An empty
    table gives an empty result.
    """
    rows = _taken(docs, key, text, source, epochs, [])
    first = F.when(F.size("positions") > 0, F.col("positions")[0]).otherwise(2.0)
    return rows.orderBy(first, "digest", "id").select(
        F.col("id").alias(key), "size", "source_size", "target", "taken", "positions"
    )


def _taken(
    docs: DataFrame, key: str, text: str, source: str, epochs: int, extra: list[Column]
) -> DataFrame:
    """Placed rows with ``taken`` and ``positions``, in no order."""
    budget, copies = F.floor("target"), []
    for epoch in range(epochs):
        place = F.col("start") + epoch * F.col("source_size")
        words = F.greatest(F.lit(0), F.least("size", budget - place))
        copies.append((place, words))
    taken = sum((w for _, w in copies[1:]), copies[0][1]).cast("long")
    places = F.array(
        *(F.when(w > 0, position(p, F.col("target"), F.col("slope"))) for p, w in copies)
    )
    return (
        _placed(docs, key, text, source, extra)
        .withColumn("taken", taken)
        .withColumn("positions", F.array_compact(places))
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` in training order, each copy a row.

    Columns are unchanged. Where a source's budget ends inside a copy, that copy's text
    ends there too, after its last budgeted word.
    """
    names = docs.columns
    rows = _taken(docs, key, text, source, EPOCHS, [rows_in_structs(docs)])
    whole = F.col("taken") - F.col("_n") * F.col("size")  # words left for this copy
    piece = rf"[\x20\x09-\x0D]*{WORD}"
    cut = F.concat_ws(
        "", F.slice(F.regexp_extract_all(f"{ROW}.`{text}`", F.lit(piece), 0), 1, whole.cast("int"))
    )
    copies = rows.select(ROW, "size", "taken", F.posexplode("positions").alias("_n", "_at"))
    own = F.when(whole < F.col("size"), cut).otherwise(F.col(f"{ROW}.`{text}`"))
    ordered = copies.withColumn("_text", own).orderBy("_at", "_n")
    return ordered.select(
        *(
            F.col("_text").alias(c) if c == text else F.col(f"{ROW}.`{c}`").alias(c)
            for c in names
        )
    )


def op5_mix_to_weights(spark: SparkSession, folder: str) -> DataFrame:
    """What the curriculum takes of every document; ``first_position`` is null if nothing."""
    rows = mix(documents(spark, folder))
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.get("positions", F.lit(0)).alias("first_position"),
    )


QUERIES = {"op5_mix_to_weights": op5_mix_to_weights}
SQL = {
    "op5_mix_to_weights": r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR) || ' ' || md5(coalesce(text, ''))) AS digest
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
           WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
           WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope
  FROM totals
), steps AS (
  -- With the sources that fill up first held to their caps, what a unit of weight gets.
  SELECT a.cap / a.weight AS reach,
         (SELECT 1.5::DOUBLE * sum(source_size) FROM totals) AS mix,
         coalesce((SELECT sum(b.cap) FROM ranked b WHERE b.cap / b.weight < a.cap / a.weight), 0) AS held,
         (SELECT sum(b.weight) FROM ranked b WHERE b.cap / b.weight >= a.cap / a.weight) AS rest
  FROM ranked a
), leveled AS (
  SELECT arg_min((mix - held) / rest, reach) AS level FROM steps WHERE (mix - held) / rest <= reach
), planned AS (
  SELECT source, source_size, slope,
         least(cap, weight * coalesce((SELECT level FROM leveled), 0)) AS target
  FROM ranked
), placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.slope,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
), cut AS (
  SELECT *,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - start)) AS one,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - source_size)) AS two
  FROM placed
)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
       CASE WHEN one > 0 THEN 2.0::DOUBLE * (start / target)
         / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope)
         + 4.0::DOUBLE * slope * (start / target))) END AS first_position
FROM cut
"""
}
