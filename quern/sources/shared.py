"""Written intermediates.

Some jobs must see one and the same result twice, for example rows that were
range-partitioned on sampled bounds. Those results are written to a folder all
executors share, so that losing an executor cannot change or lose them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"

#: Temporary folders of local applications without that setting, by application.
_local: dict[str, str] = {}

#: The folder that the caller has named for what is written.
_run: ContextVar[str | None] = ContextVar("quern_run", default=None)


def _base(spark: SparkSession) -> str:
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors can reach")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="quern-")
    return _local[context.applicationId]


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``, or in the folder of :func:`kept_in`.

    Only a local-mode session without that setting gets a temporary folder of
    its own; on a cluster such a folder would be out of the executors' reach.
    """
    return f"{_run.get() or _base(spark)}/quern-{uuid.uuid4().hex}"


@contextmanager
def kept_in(folder: str) -> Iterator[str]:
    """What queries built in here write goes below ``folder``, which all executors reach.

    The results read those files, also later. Once they are no longer needed,
    :func:`remove` deletes the folder.
    """
    token = _run.set(folder.rstrip("/"))
    try:
        yield folder
    finally:
        _run.reset(token)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of written intermediates, in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_through(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
