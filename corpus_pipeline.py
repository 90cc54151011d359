"""From raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; all but the last
return the columns of ``documents``. :func:`run` writes each stage's result to the
shared folder and reads it back, so a lost executor repeats one stage at most and no
stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import line_rules, mixing, near_copies, packing, repeats
from quern.llm.common import documents
from quern.sources import write_through


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are content; the field is fitted to their own labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_rules.only_kept(docs, line_rules.fit(docs, labels))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_copies.one_per_group(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that they share."""
    return repeats.without_repeats_rows(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, as often as the mix uses them."""
    return mixing.mixed(docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_to_weights),
    ("packing", packing_sequences),
]

#: SQL can express neither the trained field nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir))
    return docs
