"""Questions about the order of a customer's orders or a user's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import micros_between
from quern.operators import (
    by_load,
    exact_quantile,
    latest_per_key,
    top_per_key,
    with_prior,
)
from quern.operators.ordered import ROWS_PER_TASK
from quern.sources import table


def top_orders_per_customer(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's three largest orders."""
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )
    largest = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    return top_per_key(orders, "o_custkey", largest, 3)


def previous_event(
    spark: SparkSession, folder: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Each event with the same user's event before it and the time between."""
    events = table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type"
    )
    keys, order = ["user_id"], ["ts", "event_id"]
    prior = {"prior_id": "event_id", "prior_type": "event_type", "prior_ts": "ts"}
    return by_load(
        events, keys, order, lambda rows: with_prior(rows, keys, order, prior), rows_per_task
    ).select(
        "event_id",
        "user_id",
        "event_type",
        "prior_id",
        "prior_type",
        micros_between(F.col("prior_ts"), F.col("ts")).alias("micros_since"),
    )


def latest_order_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The latest order up to a date, of the customers with one by then."""
    orders = (
        table(spark, folder, "orders")
        .filter(F.col("o_orderdate") <= F.expr("TIMESTAMP_NTZ '1998-06-30 00:00:00'"))
        .select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    )
    latest = latest_per_key(
        orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"]
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_name")
    return customer.join(latest, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey", "c_name", "o_orderdate", "o_orderkey", "o_totalprice"
    )


def median_event_value(
    spark: SparkSession, folder: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The exact median value of each event type."""
    events = table(spark, folder, "events")
    median = exact_quantile(
        events, ["event_type"], "value", 0.5, "median_value", rows_per_task
    )
    return median.withColumn("median_value", F.round("median_value", 4))


QUERIES = {
    "top_orders_per_customer": top_orders_per_customer,
    "previous_event": previous_event,
    "latest_order_as_of": latest_order_as_of,
    "median_event_value": median_event_value,
}

SQL = {
    "top_orders_per_customer": """
        SELECT o_custkey, o_orderkey, o_totalprice, rank_no
        FROM (
            SELECT o_custkey, o_orderkey, o_totalprice,
                   row_number() OVER (
                       PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey
                   ) AS rank_no
            FROM orders
        )
        WHERE rank_no <= 3
    """,
    "previous_event": """
        SELECT event_id, user_id, event_type,
               lag(event_id) OVER w AS prior_id,
               lag(event_type) OVER w AS prior_type,
               epoch_us(ts) - epoch_us(lag(ts) OVER w) AS micros_since
        FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
    "latest_order_as_of": """
        SELECT c_custkey, c_name, o_orderdate, o_orderkey, o_totalprice
        FROM (
            SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice,
                   row_number() OVER (
                       PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC
                   ) AS rn
            FROM orders
            WHERE o_orderdate <= TIMESTAMP '1998-06-30 00:00:00'
        )
        JOIN customer ON c_custkey = o_custkey
        WHERE rn = 1
    """,
    "median_event_value": """
        SELECT event_type, round(quantile_cont(value, 0.5), 4) AS median_value
        FROM events
        GROUP BY event_type
    """,
}
