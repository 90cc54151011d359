"""Time the registered queries and print one JSON line.

BENCH_SF_DIR   tables to read        (default /root/testdata/sf0.1)
BENCH_CPUS     local cores           (default 8)
BENCH_REPEATS  timed rounds          (default 3, after one that is not timed)

Every round runs every query once. A query's time is the median over the timed
rounds, from building the plan to the last row being computed; results go to a
sink that drops them.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from quern.plans import QUERIES
from quern.session import local_session


def seconds(query, spark, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cores, "quern-bench")
    rounds = [
        {name: seconds(query, spark, folder) for name, query in QUERIES.items()}
        for _ in range(1 + repeats)
    ]
    spark.stop()
    times = {
        name: round(statistics.median(r[name] for r in rounds[1:]), 3) for name in QUERIES
    }
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
