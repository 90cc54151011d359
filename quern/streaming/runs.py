"""Running a stream to the end of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.sources import shared_folder

_PARTITIONS = "spark.sql.shuffle.partitions"


def session_for(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session in which a stream's state has at most ``state_partitions`` partitions.

    Every batch commits every state partition, used or not, so a stream with little
    state does better with few. It is ``spark`` itself if its setting is no larger;
    else a session of its own with the same settings, so that no other query sees the
    smaller number. The number stays what it was in a stream's first run.
    """
    if state_partitions is None or state_partitions >= int(spark.conf.get(_PARTITIONS)):
        return spark
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(_PARTITIONS, str(state_partitions))
    return own


def run_to_table(
    stream: DataFrame, folder: str | None = None, spark: SparkSession | None = None
) -> DataFrame:
    """Read all that is there, append the finished rows to Parquet, return that table.

    Offsets, state and output are kept under ``folder``, by default a new one
    in the shared folder. A run that is cut short can be started again with the
    same ``folder``: it goes on from the last committed batch, and the file sink
    counts no batch twice. So can a finished one, when there is more to read.

    The table is read by ``spark``, by default the stream's own session.
    """
    spark = spark or stream.sparkSession
    folder = folder or shared_folder(spark)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/progress")
        .option("path", f"{folder}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
