"""SimHash near-duplicates, compared through a table of pivot distances.

A document's fingerprint is the bitwise majority of the hashes of its word shingles.
Fingerprints that differ in few bits are linked; linked fingerprints form groups.

How links are found:

1. Equal fingerprints are one fingerprint from here on, however many documents have it.
2. The Hamming distances of every fingerprint to fixed reference fingerprints (pivots)
   are computed once; they are its row of the pivot table. By the triangle inequality
   two fingerprints within ``max_bits`` have rows that differ by at most ``max_bits``
   in every coordinate.
3. 64 bits fall into ``max_bits + 2`` blocks, and fingerprints within ``max_bits``
   agree in at least two of them (pigeonhole). Each pair of blocks is a key; only
   fingerprints with an equal key are compared, so no link is lost.
4. Within a key, pairs whose pivot rows differ too much in the largest coordinate are
   discarded, and the survivors verified bit by bit. Of the verified links those of
   a spanning forest are passed on, never all pairs of a group. A key with many
   fingerprints is cut into chunks and each pair of chunks is a piece of work of its
   own, so no task holds more than two chunks of a key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import (
    ROW,
    components,
    dealt,
    documents,
    rows_in_structs,
    runs,
    text_of,
    unpacked,
)
from quern.sources import write_through

#: Words of a shingle, and the bits in which linked fingerprints may differ.
WORDS = 3
MAX_BITS = 2

#: Reference fingerprints: 16 fixed 64-bit patterns, far from each other by chance.
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {i}", 0) for i in range(16)]

#: Fingerprints of one key that are compared with each other at a time.
CHUNK = 512

#: Shingles whose bits are counted at a time.
_BLOCK = 1 << 16


def _fingerprint(text: str, words: int) -> int:
    tokens = text.encode().lower().split()  # bytes: only A-Z change, ASCII spaces split
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    counts = np.zeros(64, dtype=np.int64)
    n = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, _BLOCK):
        block = tokens[low : low + _BLOCK + words - 1]
        shingles = zip(*(block[i:] for i in range(words)))
        hashes = np.array([digest(b" ".join(s), 42) for s in shingles], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > n)
    return int.from_bytes(majority.tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS):
    """The fingerprint of ``text`` as a signed long column.

    A null or empty text, or one of white space only, has fingerprint zero. A text of
    fewer than ``words`` words has one shingle, the whole sequence. Every shingle
    counts as often as it occurs. Very long texts are counted in blocks.
    """

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        values = [_fingerprint(t, words) for t in texts]
        return pd.Series(np.array(values, dtype=np.uint64).view(np.int64))

    return of(text_of(text))


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph with this adjacency matrix."""
    left = np.ones(len(near), dtype=bool)
    out = []
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            node = queue.pop()
            found = np.flatnonzero(near[node] & left).tolist()
            for other in found:
                out.append((node, other))
            left[found] = False
            queue += found
    return out


def _links_of(max_bits: int):
    def step(part: pd.DataFrame) -> pd.DataFrame:
        prints = part["fp"].to_numpy().view(np.uint64)
        table = np.stack([part["t0"].to_numpy(), part["t1"].to_numpy()], axis=1)
        table = np.ascontiguousarray(table).view(np.uint8).astype(np.int16)
        near = np.zeros((len(part), len(part)), dtype=bool)
        for i in range(len(part) - 1):
            # The largest coordinate difference of pivot distances discards pairs ...
            gap = np.abs(table[i + 1 :] - table[i]).max(axis=1)
            rest = i + 1 + np.flatnonzero(gap <= max_bits)
            # ... and only the survivors are compared bit by bit.
            rest = rest[np.bitwise_count(prints[rest] ^ prints[i]) <= max_bits]
            near[i, rest] = near[rest, i] = True
        if part["i"].iloc[0] != part["j"].iloc[0]:
            side = part["side"].to_numpy()
            near &= side[:, None] != side[None, :]
        found = np.array(_forest(near), dtype=np.int64).reshape(-1, 2)
        values = prints.view(np.int64)
        return pd.DataFrame({"a": values[found[:, 0]], "b": values[found[:, 1]]})

    return runs(["key", "i", "j"], step)


def links(prints: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)``: links that connect all of ``prints (fp long, distinct)`` within reach.

    Not every pair within ``max_bits`` is returned, but every such pair is connected by
    the returned links, and every returned link is within ``max_bits``.
    """
    blocks = max_bits + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))) for p in PIVOTS]

    def packed(columns):
        out = F.lit(0).cast("long")
        for i, c in enumerate(columns):
            out = out.bitwiseOR(F.shiftleft(c.cast("long"), 8 * i))
        return out

    keys = F.array(
        *(
            F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed(masks[x] | masks[y]))))
            for n, (x, y) in enumerate(combinations(range(blocks), 2))
        )
    )
    table = prints.select("fp", packed(distance[:8]).alias("t0"), packed(distance[8:]).alias("t1"))
    cells = table.withColumn("key", F.explode(keys))
    sizes = write_through(  # so that the join below can split a large key
        cells.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    )
    mine = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks")).cast("int")
    work = (
        cells.join(sizes, "key")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "key",
            F.least("mine", "other").alias("i"),
            F.greatest("mine", "other").alias("j"),
            (F.col("mine") < F.col("other")).cast("int").alias("side"),
            "fp",
            "t0",
            "t1",
        )
    )
    return (
        dealt(work, "key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInPandas(_links_of(max_bits), "a long, b long")
    )


def grouped(
    prints: DataFrame, max_bits: int = MAX_BITS, linked: DataFrame | None = None
) -> DataFrame:
    """``(fp, root, component)`` of every fingerprint of ``prints (id, fp)``.

    ``root`` names the group; ``component`` is the smallest non-null id in it. Groups are
    those of ``linked (a, b)`` if given, else of fingerprints within ``max_bits``.
    """
    prints = write_through(prints.groupBy("fp").agg(F.min("id").alias("first")))
    if linked is None:
        linked = links(prints.select("fp"), max_bits)
    groups = write_through(components(linked))
    members = groups.join(prints, groups["node"] == prints["fp"])
    firsts = members.groupBy("root").agg(F.min("first").alias("component"))
    named = groups.join(firsts, "root").select(F.col("node").alias("fp"), "root", "component")
    # Written, so that the join with it is a plain one, whose hot keys Spark can split.
    return write_through(
        prints.join(named, "fp", "left").select(
            "fp",
            F.coalesce("root", "fp").alias("root"),
            F.coalesce("component", "first").alias("component"),
        )
    )


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``(<key>, fingerprint, component_id)``, one row per row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits. ``component_id`` is the smallest key
    among the rows whose fingerprints are reachable, the row's own included; rows with
    a null key take part, and the id is null only where all keys are. Repeated rows are
    returned as often as they come. An empty table gives an empty result.
    """
    own = write_through(
        docs.select(F.col(key).alias("id"), fingerprints(docs, text, words).alias("fp"))
    )
    return own.join(grouped(own, max_bits), "fp").select(
        F.col("id").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def one_per_group(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: one row of each group stays.

    It is the row with the group's smallest key; of several rows with that key, the
    smallest row by its text and then its other columns. The columns are unchanged.
    """
    print_of = fingerprints(docs, text, words).alias("fp")
    own = write_through(docs.select(F.col(key).alias("id"), print_of))
    return one_of_each(docs, grouped(own, max_bits), print_of, key, text)


def one_of_each(
    docs: DataFrame, groups: DataFrame, print_of: Column, key: str, text: str
) -> DataFrame:
    """The first row of each of ``groups (fp, root, component)``; ``print_of`` is ``fp`` of a row."""
    names = docs.columns
    rows = docs.select(rows_in_structs(docs), F.col(key).alias("id"), print_of)
    first = rows.join(groups, "fp").filter(F.col("id").eqNullSafe(F.col("component")))
    # Mostly one row a group by now; the aggregate also holds for many repeated rows.
    order = F.struct(F.col(f"{ROW}.`{text}`").alias("t"), F.col(ROW).alias("r"))
    kept = first.groupBy("root").agg(F.min(order).alias("o"))
    return unpacked(kept.select(F.col("o.r").alias(ROW)), names)


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return near_duplicates(documents(spark, folder))


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
SQL: dict[str, str] = {}
