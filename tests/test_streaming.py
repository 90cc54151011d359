from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from conftest import DATA, rows_of

from quern.plans import QUERIES
from quern.sources import stream_table, table
from quern.sources.tables import SCHEMAS
from quern.streaming import hourly_counts, run_to_table, session_for

START = datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of events that arrive file by file."""
    folder = tmp_path / "feed"
    ids = iter(range(10**6))

    class Feed:
        def arrive(self, *minutes, kind="view", value=1.1):
            rows = [
                (next(ids), START + timedelta(minutes=m), 1, kind, value, "{}") for m in minutes
            ]
            df = spark.createDataFrame(rows, SCHEMAS["events"])
            df.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")

        def run(self):
            events = stream_table(spark, str(folder), "events")
            found = run_to_table(hourly_counts(events), str(tmp_path / "run"))
            return sorted(
                ((r["hour"] - START) // timedelta(hours=1), r["n_events"], r["total_value"])
                for r in found.collect()
            )

    return Feed()


def test_hours_come_out_once_when_they_are_over(feed):
    feed.arrive(1, 2, 61)
    assert feed.run() == []
    feed.arrive(125)
    assert feed.run() == [(0, 2, 2.2)]
    assert feed.run() == [(0, 2, 2.2)]
    feed.arrive(300)
    assert feed.run() == [(0, 2, 2.2), (1, 1, 1.1), (2, 1, 1.1)]


def test_late_events_count_until_their_hour_is_out(feed):
    feed.arrive(1, 100)
    feed.run()
    feed.arrive(5)  # 95 minutes late, but its hour is not out yet
    feed.run()
    feed.arrive(130)
    assert feed.run() == [(0, 2, 2.2)]
    feed.arrive(6)  # its hour is out
    feed.arrive(400)
    assert [r for r in feed.run() if r[0] == 0] == [(0, 2, 2.2)]


def test_a_batch_cut_short_is_not_counted_twice(feed, tmp_path):
    feed.arrive(1, 2)
    feed.run()
    feed.arrive(200, 400)
    before = feed.run()
    assert before == [(0, 2, 2.2), (3, 1, 1.1)]
    # As if the run had ended after writing its rows and before noting so.
    commits = tmp_path / "run" / "progress" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    for name in (f"{last}", f".{last}.crc", f"{last - 1}", f".{last - 1}.crc"):
        (commits / name).unlink()
    assert feed.run() == before
    feed.arrive(600)
    assert feed.run() == [*before, (6, 1, 1.1)]


def test_one_run_over_a_backlog_out_of_order_loses_nothing(feed):
    feed.arrive(500)
    feed.arrive(1)
    feed.arrive(200)
    assert feed.run() == [(0, 1, 1.1), (3, 1, 1.1)]


def test_many_batches_give_the_batch_result(spark, tmp_path):
    source, folder = f"{DATA}/sf0.001", str(tmp_path)
    events = table(spark, source, "events").orderBy("ts")
    # Written one after another, since the source takes files in order of age.
    edges = [0, 200, 500, 501, 900, 10**9]
    for low, high in zip(edges, edges[1:]):
        part = events.filter(f"event_id >= {low} AND event_id < {high}")
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    stream = stream_table(spark, folder, "events", max_bytes_per_batch=1)
    found = run_to_table(hourly_counts(stream), f"{folder}/run")
    assert rows_of(found) == rows_of(QUERIES["hourly_event_stream"](spark, source))


def test_the_same_numbers_as_in_batch(spark):
    folder = f"{DATA}/sf0.01"
    stream = QUERIES["hourly_event_stream"](spark, folder)
    batch = QUERIES["hourly_event_counts"](spark, folder)
    assert stream.exceptAll(batch).count() == 0


def test_a_stream_with_little_state_has_few_partitions(spark, settings, tmp_path):
    settings(spark__sql__shuffle__partitions="200")
    own = session_for(spark, 3)
    # Queries that are planned while the stream starts and runs see no other setting.
    assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    assert own.conf.get("spark.sql.shuffle.partitions") == "3"
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    events = stream_table(own, f"{DATA}/sf0.001", "events")
    folder = str(tmp_path / "run")
    found = run_to_table(hourly_counts(events), folder, spark=spark)
    assert len([p for p in os.listdir(f"{folder}/progress/state/0") if p.isdigit()]) == 3
    assert spark.range(10).repartition("id").groupBy("id").count().sparkSession is spark
    assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    settings(spark__sql__shuffle__partitions="4")
    assert rows_of(found) == rows_of(QUERIES["hourly_event_stream"](spark, f"{DATA}/sf0.001"))


def test_state_partitions_are_the_sessions_unless_fewer_are_asked_for(spark):
    assert session_for(spark) is spark
    assert session_for(spark, 1_000_000) is spark


def test_a_stream_in_batches_from_the_query(spark):
    source = f"{DATA}/sf0.001"
    whole = rows_of(QUERIES["hourly_event_stream"](spark, source))
    few = QUERIES["hourly_event_stream"](spark, source, state_partitions=2, max_bytes_per_batch=1)
    assert rows_of(few) == whole
