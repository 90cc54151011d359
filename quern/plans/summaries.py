"""Grouped totals and joins over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import amount, exact_sum, shown, sum_of_amounts
from quern.operators import cube_of, rollup_of, without_match
from quern.sources import table


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities and prices of the lines shipped by a date, per flag and status."""
    price = (F.col("l_extendedprice"), 2)
    kept = (F.lit(1.0) - F.col("l_discount"), 2)
    taxed = (F.lit(1.0) + F.col("l_tax"), 2)
    totals = (
        table(spark, folder, "lineitem")
        .filter(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02 00:00:00'"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            exact_sum((F.col("l_quantity"), 2)).alias("quantity"),
            exact_sum(price).alias("price"),
            exact_sum(price, kept).alias("discounted"),
            exact_sum(price, kept, taxed).alias("charged"),
            exact_sum((F.col("l_discount"), 2)).alias("discount"),
        )
    )
    mean_discount = F.col("discount").cast("double") / F.col("n_lines")
    return totals.select(
        "l_returnflag",
        "l_linestatus",
        "n_lines",
        *(
            shown(F.col(name)).alias(name)
            for name in ("quantity", "price", "discounted", "charged")
        ),
        F.round(mean_discount, 6).alias("mean_discount"),
    )


def orders_per_nation(spark: SparkSession, folder: str) -> DataFrame:
    """Number and value of the orders from each nation's customers."""
    # One row per customer before the join, so no customer's orders are a hot
    # join key, and the join finds the rows already partitioned by customer.
    per_customer = (
        table(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            exact_sum((F.col("o_totalprice"), 2)).alias("total"),
        )
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(
            F.sum("n").alias("n_orders"),
            shown(F.sum("total")).alias("total_price"),
        )
    )


def local_supplier_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue of one region's nations from suppliers in the buyer's own nation."""
    region = table(spark, folder, "region").filter(F.col("r_name") == "ASIA")
    nation = (
        table(spark, folder, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name")
    )
    customer = table(spark, folder, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi"
    )
    orders = table(spark, folder, "orders").filter(
        (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'"))
        & (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"))
    )
    # Orders are cut down to the region's before they meet the lines, and lines
    # to three numbers before they are shuffled.
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_nationkey"
    )
    price = (F.col("l_extendedprice"), 2)
    kept = (F.lit(1.0) - F.col("l_discount"), 2)
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", amount(price, kept).alias("paid")
    )
    # Summed per supplier and nation, so that the supplier join carries no lines.
    per_supplier = (
        lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", "c_nationkey")
        .agg(sum_of_amounts(F.col("paid"), 4, factors=2).alias("revenue"))
    )
    supplier = (
        table(spark, folder, "supplier")
        .select("s_suppkey", "s_nationkey")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    )
    local = (F.col("l_suppkey") == F.col("s_suppkey")) & (
        F.col("c_nationkey") == F.col("s_nationkey")
    )
    return (
        per_supplier.join(supplier, local)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(shown(F.sum("revenue")).alias("revenue"))
    )


def orders_without_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that have no line, counted per priority."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", "o_totalprice"
    )
    lines = table(spark, folder, "lineitem")
    return (
        without_match(orders, "o_orderkey", lines, "l_orderkey")
        .groupBy("o_orderpriority")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            shown(exact_sum((F.col("o_totalprice"), 2))).alias("total_price"),
        )
    )


_DIMENSIONS = ["o_orderstatus", "o_orderpriority"]


def _order_measures():
    return {
        "n_orders": F.count(F.lit(1)),
        "total_price": exact_sum((F.col("o_totalprice"), 2)),
    }


def order_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per status and priority, per status, and in all."""
    orders = table(spark, folder, "orders")
    return rollup_of(orders, _DIMENSIONS, _order_measures()).withColumn(
        "total_price", shown(F.col("total_price"))
    )


def order_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per status and priority, and every subtotal of those."""
    orders = table(spark, folder, "orders")
    return cube_of(orders, _DIMENSIONS, _order_measures()).withColumn(
        "total_price", shown(F.col("total_price"))
    )


def users_per_event_type(spark: SparkSession, folder: str) -> DataFrame:
    """Events and distinct users of each event type."""
    return (
        table(spark, folder, "events")
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_distinct("user_id").alias("n_users"),
        )
    )


QUERIES = {
    "pricing_summary": pricing_summary,
    "orders_per_nation": orders_per_nation,
    "local_supplier_revenue": local_supplier_revenue,
    "orders_without_lines": orders_without_lines,
    "order_rollup": order_rollup,
    "order_cube": order_cube,
    "users_per_event_type": users_per_event_type,
}

SQL = {
    "pricing_summary": """
        WITH line AS (
            SELECT l_returnflag, l_linestatus,
                   (CASE WHEN isfinite(l_quantity) THEN l_quantity END)::DECIMAL(18, 6) AS qty,
                   (CASE WHEN isfinite(l_extendedprice) THEN l_extendedprice END)::DECIMAL(18, 6) AS price,
                   (1 - (CASE WHEN isfinite(l_discount) THEN l_discount END)::DECIMAL(8, 6))::DECIMAL(8, 6) AS kept,
                   (1 + (CASE WHEN isfinite(l_tax) THEN l_tax END)::DECIMAL(8, 6))::DECIMAL(8, 6) AS taxed,
                   (CASE WHEN isfinite(l_discount) THEN l_discount END)::DECIMAL(8, 6) AS discount
            FROM lineitem
            WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
        )
        SELECT l_returnflag, l_linestatus,
               count(*) AS n_lines,
               sum(qty)::DOUBLE AS quantity,
               sum(price)::DOUBLE AS price,
               sum(price * kept)::DECIMAL(38, 6)::DOUBLE AS discounted,
               sum(price * kept * taxed)::DECIMAL(38, 6)::DOUBLE AS charged,
               round(sum(discount)::DOUBLE / count(*), 6) AS mean_discount
        FROM line
        GROUP BY l_returnflag, l_linestatus
    """,
    "orders_per_nation": """
        SELECT n_name,
               count(*) AS n_orders,
               sum((CASE WHEN isfinite(o_totalprice) THEN o_totalprice END)::DECIMAL(18, 6))::DOUBLE AS total_price
        FROM nation
        JOIN customer ON c_nationkey = n_nationkey
        JOIN orders ON o_custkey = c_custkey
        GROUP BY n_name
    """,
    "local_supplier_revenue": """
        SELECT n_name,
               sum((CASE WHEN isfinite(l_extendedprice) THEN l_extendedprice END)::DECIMAL(18, 6)
                   * (1 - (CASE WHEN isfinite(l_discount) THEN l_discount END)::DECIMAL(8, 6))::DECIMAL(8, 6)
               )::DECIMAL(38, 6)::DOUBLE AS revenue
        FROM region
        JOIN nation ON n_regionkey = r_regionkey
        JOIN customer ON c_nationkey = n_nationkey
        JOIN orders ON o_custkey = c_custkey
        JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey
        WHERE r_name = 'ASIA'
          AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'
          AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
        GROUP BY n_name
    """,
    "orders_without_lines": """
        SELECT o_orderpriority,
               count(*) AS n_orders,
               sum((CASE WHEN isfinite(o_totalprice) THEN o_totalprice END)::DECIMAL(18, 6))::DOUBLE AS total_price
        FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
        GROUP BY o_orderpriority
    """,
    "order_rollup": """
        SELECT o_orderstatus, o_orderpriority,
               GROUPING(o_orderstatus, o_orderpriority)::BIGINT AS level,
               count(*) AS n_orders,
               sum((CASE WHEN isfinite(o_totalprice) THEN o_totalprice END)::DECIMAL(18, 6))::DOUBLE AS total_price
        FROM orders
        GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
    """,
    "order_cube": """
        SELECT o_orderstatus, o_orderpriority,
               GROUPING(o_orderstatus, o_orderpriority)::BIGINT AS level,
               count(*) AS n_orders,
               sum((CASE WHEN isfinite(o_totalprice) THEN o_totalprice END)::DECIMAL(18, 6))::DOUBLE AS total_price
        FROM orders
        GROUP BY CUBE (o_orderstatus, o_orderpriority)
    """,
    "users_per_event_type": """
        SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users
        FROM events
        GROUP BY event_type
    """,
}
