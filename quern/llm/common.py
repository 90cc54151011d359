"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import write_through

#: The column that carries an input row unchanged, so that no name can clash.
ROW = "_row"

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition into as many partitions as the session shuffles into.

    The number is given because otherwise small partitions would be joined together; here
    they are small in bytes and long in work.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *columns)


def rows_in_structs(docs: DataFrame) -> Column:
    """All columns of a row as one struct, to be unpacked by :func:`unpacked`."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(f"{ROW}.`{c}`").alias(c) for c in columns))


def runs(
    keys: list[str], step: Callable[[pd.DataFrame], pd.DataFrame]
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over partitions sorted by ``keys``: ``step`` on each key's rows.

    Only the rows of the key at hand are kept, so it suits keys whose size has been
    bounded before. Unlike applyInPandas it costs little for very many small keys.
    """

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        last: tuple | None = None
        for frame in frames:
            if not len(frame):
                continue
            new = np.zeros(len(frame), dtype=bool)
            for key in keys:
                values = frame[key].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), len(frame)]
            for a, b in zip(starts, starts[1:]):
                part = frame.iloc[a:b]
                key_now = tuple(part[key].iloc[0] for key in keys)
                if last is not None and key_now != last:
                    yield step(pd.concat(kept, ignore_index=True))
                    kept = []
                last = key_now
                kept.append(part)
        if kept:
            yield step(pd.concat(kept, ignore_index=True))

    return over


def _state(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mark)).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links (a long, b long)``; root is the smallest.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until the
    links are stars around each component's smallest node, which takes a number of
    rounds logarithmic in the size of a component. A node with very many links costs
    no more than one with few: minima are taken with map-side combining, and each join
    meets one row per node. Every round is written to the shared folder, so a lost
    executor repeats at most one.
    """
    pairs = F.col("a") != F.col("b")
    now = write_through(
        links.filter(pairs)
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a")
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("l")
        )
        now = write_through(small.select("l.a", "l.b").filter(pairs).distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
