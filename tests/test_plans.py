"""What Spark makes of the queries: scans, shuffles, and skewed keys."""

from __future__ import annotations

import re

import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from quern.plans import QUERIES
from quern.sources import table


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def query_plan(spark, name, sf="0.01") -> str:
    return plan_of(QUERIES[name](spark, f"{DATA}/sf{sf}"))


READS = {
    "orders_per_nation": ["o_custkey", "o_totalprice"],
    "orders_without_lines": ["l_orderkey"],
    "users_per_event_type": ["user_id", "event_type"],
    "median_event_value": ["event_type", "value"],
    "events_per_property": ["value", "props"],
    "hourly_event_counts": ["ts", "event_type", "value"],
}


@pytest.mark.parametrize("name", READS)
def test_scans_read_only_what_is_used(spark, name):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", query_plan(spark, name))
    columns = [[f.split(":")[0] for f in schema.split(",")] for schema in schemas]
    assert sorted(READS[name]) in [sorted(c) for c in columns]


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("pricing_summary", "LessThanOrEqual(l_shipdate"),
        ("latest_order_as_of", "LessThanOrEqual(o_orderdate"),
        ("local_supplier_revenue", "EqualTo(r_name,ASIA)"),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in query_plan(spark, name).replace(" ", "")


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_joins_and_no_python(spark, name):
    plan = query_plan(spark, name, "0.001")
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Arrow"):
        assert node not in plan


def test_top_rows_are_cut_before_the_shuffle(spark):
    plan = query_plan(spark, "top_orders_per_customer")
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert re.search(r"WindowGroupLimit .* 3, Partial", below)


def test_anti_join_reuses_the_partitioning_of_the_distinct_keys(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = query_plan(spark, "orders_without_lines")
    # Orders, line keys, and the five result groups; nothing else is shuffled.
    assert plan.count("Exchange") == 3


def test_nation_totals_shuffle_no_orders_twice(spark, settings):
    # As on a cluster, where customers are too many to broadcast.
    settings(spark__sql__autoBroadcastJoinThreshold="5000")
    plan = query_plan(spark, "orders_per_nation")
    # Order totals and customers by customer, and the 25 results.
    assert plan.count("Exchange hashpartitioning") == 3
    assert "partial_sum" in plan[plan.index("Exchange hashpartitioning(o_custkey") :]


def test_subtotals_expand_cells_not_rows(spark):
    plan = query_plan(spark, "order_cube")
    below = plan[plan.index("Expand") :]
    assert "HashAggregate" in below


@pytest.mark.parametrize(
    "name, key, other",
    [
        ("lineitem", "l_orderkey", "l_extendedprice"),
        ("orders", "o_custkey", "o_totalprice"),
    ],
)
def test_a_hot_key_is_split_in_the_fact_joins(spark, settings, tmp_path, name, key, other):
    """A key with a third of all rows must not end up in one task."""
    source, folder = f"{DATA}/sf0.01", str(tmp_path)
    # A key whose rows stay in the result: the right years, nation and region.
    orders = table(spark, source, "orders").filter("year(o_orderdate) = 1996")
    bought = orders.join(table(spark, source, "customer"), F.expr("o_custkey = c_custkey"))
    kept = bought.filter("c_nationkey = 2").agg(F.min("o_orderkey"), F.min("o_custkey")).first()
    hot = kept[0] if name == "lineitem" else kept[1]
    for each in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        df = table(spark, source, each)
        if each == name:
            third = F.abs(F.hash(other)) % 3 == 0
            value = F.when(third, F.lit(hot)).otherwise(F.col(key))
            df = df.withColumn(key, value.cast("bigint")).repartition(16)
        df.write.parquet(f"{folder}/{each}.parquet")
    query = QUERIES["local_supplier_revenue"]
    plain = rows_of(query(spark, folder))
    settings(
        spark__sql__autoBroadcastJoinThreshold="5000",
        spark__sql__adaptive__autoBroadcastJoinThreshold="5000",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10000",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="12000",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__shuffle__partitions="16",
    )
    skewed = query(spark, folder)
    found = rows_of(skewed)
    assert found == plain
    joins = re.findall(r"\w+Join\(skew=true\) \[(\w+)#", plan_of(skewed))
    assert key in joins
