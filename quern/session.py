"""A Spark session with the settings these jobs are measured with.

The queries take whatever session they are given and depend on none of these
settings for right results; the settings only matter for speed.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(
    cores: int = 8,
    app: str = "quern",
    memory: str = "12g",
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        # Hash joins where AQE sees that every partition's hash table is small.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
