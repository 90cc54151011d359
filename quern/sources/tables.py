"""Parquet tables, one ``<name>.parquet`` file or directory each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Stated rather than inferred: inference costs a job per read, and depends on a
# session setting for the time columns.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The whole table. Column pruning and filters reach the scan from the query."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def stream_table(
    spark: SparkSession,
    folder: str,
    name: str,
    max_bytes_per_batch: int | None = None,
) -> DataFrame:
    """The table as a stream of its files.

    Without ``max_bytes_per_batch`` the first ``availableNow`` run takes every
    file in one batch, so a backlog whose files are not in event-time order
    loses nothing to the watermark. Set it only where files arrive in order.
    """
    reader = spark.readStream.schema(SCHEMAS[name])
    if max_bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_batch)
    # A glob, because the file source takes a plain path only for a directory.
    return reader.parquet(f"{folder}/{name}.{{parquet}}")
