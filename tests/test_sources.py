from __future__ import annotations

import os

import pytest
from conftest import DATA, TABLES, rows_of

from quern.plans import QUERIES
from quern.sources import kept_in, remove, shared_folder, table, write_through
from quern.sources.tables import SCHEMAS


@pytest.mark.parametrize("name", TABLES)
def test_stated_schemas_are_those_of_the_files(spark, name):
    path = f"{DATA}/sf0.001/{name}.parquet"
    assert table(spark, f"{DATA}/sf0.001", name).schema == spark.read.parquet(path).schema
    assert name in SCHEMAS


def test_written_tables_are_in_the_shared_folder(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = spark.range(100).selectExpr("id", "if(id % 2 = 0, null, 'x') AS s")
    before = set(os.listdir(base))
    written = write_through(df)
    assert rows_of(written) == rows_of(df)
    (new,) = set(os.listdir(base)) - before
    files = [f.replace("file:///", "file:/") for f in written.inputFiles()]
    assert files and all(f.startswith(f"file:{base}/{new}/") for f in files)


class _Session:
    """Just what ``shared_folder`` asks of a session."""

    def __init__(self, master, **conf):
        self.conf = self
        self.values = conf
        self.sparkContext = self
        self.master = master
        self.applicationId = f"app-{id(self)}"

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_Session("yarn"))
    named = _Session("yarn", **{"spark.checkpoint.dir": "hdfs://nn/tmp/"})
    assert shared_folder(named).startswith("hdfs://nn/tmp/quern-")


def test_a_local_session_without_one_gets_a_folder_of_its_own():
    session = _Session("local[2]")
    first, second = shared_folder(session), shared_folder(session)
    assert os.path.dirname(first) == os.path.dirname(second) and first != second
    assert not session.values  # the session's settings are the caller's


def test_intermediates_can_be_named_and_removed(spark, tmp_path):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before, folder = set(os.listdir(base)), str(tmp_path / "mine")
    with kept_in(folder):
        found = QUERIES["previous_event"](spark, f"{DATA}/sf0.001", rows_per_task=20)
    assert os.listdir(folder) and set(os.listdir(base)) == before
    assert found.count() == 1000  # readable until they are removed
    remove(spark, folder)
    assert not os.path.exists(folder)
