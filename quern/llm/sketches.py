"""Bottom-k sketches: document fingerprints that can be compared and merged.

The sketch of a text is the ``k`` smallest distinct hashes of its word shingles. The
smallest hashes of two sketches together are a uniform sample of both texts' shingles,
which gives estimates of resemblance, containment and distinct counts; and the sketch of
a text in parts is the ``k`` smallest of its parts' sketches.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, documents, text_of
from quern.sources import write_through

WORDS = 5
K = 128

#: Ranges that the order of all rows is cut into, at most; one small row each is broadcast.
RANGES = 100_000
#: Rows of a range, about, unless there would be more ranges than that.
RANGE_ROWS = 5_000
#: Keys that repeat are collected if they have more rows than a range and than this share of
#: the table, so at most so many.
HOT_KEYS = 10_000
#: Copies of a row that a task writes out at a time.
COPIES = 10_000


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """A 64-bit hash of every shingle; a text of fewer words has one, of all its words."""
    own = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return F.transform(
        F.array(own),  # names the word hashes, so that they are computed once
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<long>"))
        .when(F.size(h) < words, F.array(F.xxhash64(h)))
        .otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - (words - 1))),
                lambda i: F.xxhash64(F.slice(h, i, words)),
            )
        ),
    )[0]


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The ``k`` smallest distinct shingle hashes, ascending; none for an empty text."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together (of shingles within either)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(rows: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group. Parts are merged where they are before they are shuffled:
    the hashes of a group are distinct rows, ranked in two steps, so that a group of any
    number of parts is never in one task as a whole."""
    hashes = rows.select(*by, F.explode(column).alias("_h")).distinct()
    salted = hashes.withColumn("_salt", F.pmod("_h", F.lit(64)))
    lowest = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    few = salted.withColumn("_r", lowest([*by, "_salt"])).filter(F.col("_r") <= k)
    few = few.withColumn("_r", lowest(by)).filter(F.col("_r") <= k)
    return few.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated shared shingles over all shingles of both; 1 for two empty texts."""
    return _shared(merged(a, b, k), a, b)


def _shared(both: Column, a: Column, b: Column) -> Column:
    """The share of the sample ``both`` of two sketches that is in either."""
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 if it has none."""
    both = merged(a, b, k)
    return _contained(_shared(both, a, b), both, a, k)


def _contained(near: Column, both: Column, a: Column, k: int = K) -> Column:
    own = distinct_shingles(a, k)
    return F.when(own == 0, 1.0).otherwise(
        F.least(F.lit(1.0), near * distinct_shingles(both, k) / F.greatest(own, F.lit(1.0)))
    )


def as_text(a: Column) -> Column:
    """The sketch as one string of 16 hexadecimal digits a hash; equal for equal sketches."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def distinct_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, text, copies)`` without equal rows, and ``(id, n)`` of keys that repeat.

    Rows are compared only where their keys repeat, or are null, and are added up where they
    are before they are shuffled.
    """
    keys = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL")
    keys = write_through(keys)
    found = keys.count()
    if not found:
        return rows.withColumn("copies", F.lit(1).cast("long")), keys
    known = F.broadcast(keys) if found <= RANGES else keys
    marked = rows.join(known.withColumnRenamed("id", "key"), F.col("id").eqNullSafe(F.col("key")), "left")
    single = marked.filter("n IS NULL").select("id", "text", F.lit(1).cast("long").alias("copies"))
    many = marked.filter("n IS NOT NULL").groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
    return single.unionByName(many.select("id", "text", "copies")), keys


def _range_of(rows: DataFrame, total: int, keys: DataFrame) -> DataFrame:
    """``rows`` with ``range``, a number in order of the key and, of one key's rows, the mark."""
    cells = max(1, min(1000, math.isqrt(total)))
    shares = [i / cells for i in range(cells + 1)]
    bounds = set(rows.agg(F.percentile_approx("id", shares, 10 * cells)).first()[0] or [0])
    most = max(RANGE_ROWS, total // HOT_KEYS)
    hot = {r["id"]: r["n"] for r in keys.filter(F.col("n") > most).collect()}
    # A hot key is a cell of its own, and cut by the marks of its rows.
    bounds |= {k for k in hot if k is not None} | {k + 1 for k in hot if k is not None and k < 2**63 - 1}
    bounds = sorted(bounds)
    most_parts = max(1, RANGES // (len(bounds) + 1))
    even = min(most_parts, max(1, -(-total // (cells * RANGE_ROWS))))
    parts = [min(most_parts, max(1, -(-hot[x] // RANGE_ROWS))) if x in hot else even for x in bounds]
    first_of = [0]
    for n in parts:
        first_of.append(first_of[-1] + n)
    of = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cell") + 1)
    starts = F.array(*(F.lit(x).cast("long") for x in bounds))
    ends = [float(y) for y in [*bounds[1:], bounds[-1] + 1]]
    # In doubles, which keep the order and hold any difference of two keys.
    by_id = (F.col("id").cast("double") - of([float(x) for x in bounds], "double")) / of(
        [max(1.0, y - float(x)) for x, y in zip(bounds, ends)], "double"
    )
    by_mark = (F.col("mark").cast("double") + 2.0**63) / 2.0**64
    place = F.when(of([x in hot for x in bounds], "boolean"), by_mark).otherwise(by_id)
    of_null = min(most_parts, max(1, -(-hot.get(None, 0) // RANGE_ROWS)))
    within = lambda share, n: F.least(F.floor(share * n), n - 1)
    cell = F.greatest(F.lit(1), F.size(F.filter(starts, lambda b: b <= F.col("id")))) - 1
    number = of(first_of[:-1], "long") + within(place, of(parts, "long"))
    number = F.when(F.col("id").isNull(), within(by_mark, F.lit(of_null).cast("long")) - of_null).otherwise(number)
    return rows.withColumn("cell", cell).withColumn("range", number).drop("cell")


def with_next(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """``(id, text, sketch, next_text, next_sketch)``: each of :func:`distinct_rows` by the next.

    Rows are in ascending order of ``id``, nulls first, ties by a hash of the text and then
    the text; the last row's next is the first. The order is cut into ranges: quantiles of
    the keys, each cut evenly again, and keys of very many rows by their texts' hashes. A
    copy of each range's first row ends the range before it, so a range needs no other one.
    At most a thousand bounds and :data:`HOT_KEYS` keys are collected, and a row of three
    numbers for each of at most :data:`RANGES` ranges is broadcast.
    """
    rows = _range_of(rows.select("id", "text", F.xxhash64("text").alias("mark")), total, keys)
    # The first row of each range, by fixed-width columns only; then its text.
    order = F.struct(F.col("id"), F.col("mark"))
    firsts = rows.groupBy("range").agg(F.min(order).alias("first"))
    along = Window.orderBy("range")  # a row for each range
    before = F.coalesce(F.lag("range").over(along), F.max("range").over(Window.partitionBy()))
    firsts = firsts.select("range", "first", before.alias("ends"))
    heads = (
        rows.join(F.broadcast(firsts), "range")
        .filter(order.eqNullSafe(F.col("first")))
        .groupBy("ends", "first")
        .agg(F.min("text").alias("text"))
        .select(
            "first.id",
            "text",
            F.col("first.mark").alias("mark"),
            F.col("ends").alias("range"),
            F.lit(1).alias("head"),
        )
    )
    # Ranges are of like size, so they are dealt out in turns.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.withColumn("head", F.lit(0)).unionByName(heads)
    ranges = ranges.withColumn("task", F.pmod("range", F.lit(tasks)).cast("int")).repartitionById(tasks, "task")
    sketched = ranges.withColumn("sketch", sketch(F.col("text")))
    inside = Window.partitionBy("task", "range").orderBy("head", "id", "mark", "text")
    return (
        sketched.withColumn("next", F.lead(F.struct("text", "sketch")).over(inside))
        .filter("head = 0")
        .select(
            "id",
            "text",
            "sketch",
            F.col("next.text").alias("next_text"),
            F.col("next.sketch").alias("next_sketch"),
        )
    )


def _compared(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """The edited text of each row, and its and the next text's likeness to the text."""
    size, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    head, tail = F.substring("text", F.lit(1), size - quarter), F.substring("next_text", F.lit(1), quarter)
    # In steps, so that each array is made once.
    rows = rows.withColumn("edited", F.concat(head, tail))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    rows = rows.withColumn("both", merged(own, edited)).withColumn("both_next", merged(own, following))
    rows = rows.withColumn("near_edited", _shared(F.col("both"), own, edited))
    rows = rows.withColumn("near_next", _shared(F.col("both_next"), own, following))
    return rows.select(
        F.col("id").alias(key),
        size.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(edited).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        _contained(F.col("near_edited"), F.col("both"), own).alias("contained_in_edited"),
        _contained(F.col("near_next"), F.col("both_next"), own).alias("contained_in_next"),
        F.round(distinct_shingles(own)).cast("long").alias("n_shingles"),
        *more,
    )


def edited_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row's text, edited text and next text, compared.

    The edited text has its last quarter (rounded down, in characters) replaced by as
    many first characters of the next row's text, or all of it if shorter. Null texts are
    empty, null keys come first; keys are whole numbers of any size. Of rows with one key
    the next is by a hash of the text, and a row's copy is next to it, but for the last one.
    A single row is next to itself. An empty table gives an empty result.
    """
    rows, keys = distinct_rows(docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("text")))
    last = _compared(with_next(rows, keys, docs.count()), key)
    if not keys.count():
        return last
    # All copies of a row but the last, each next to another one; a row of very many in parts.
    others = F.col("copies") - 1
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((others - 1) / COPIES)))
    copied = rows.filter("copies > 1").withColumn("part", parts)
    copied = copied.withColumn("n", F.least(F.lit(COPIES), others - F.col("part") * COPIES).cast("int"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copied = copied.select("id", "text", "n").repartition(tasks).withColumn("sketch", sketch(F.col("text")))
    copied = copied.withColumn("next_text", F.col("text")).withColumn("next_sketch", F.col("sketch"))
    found = _compared(copied, key, "n").withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    return last.unionByName(found.drop("n"))


def op8_bottom_k_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document, its edited text and its likeness to the next."""
    return edited_neighbours(documents(spark, folder))


QUERIES = {"op8_bottom_k_fingerprints": op8_bottom_k_fingerprints}
SQL: dict[str, str] = {}
