"""Written tables: where they are, how long they live, and what is refused."""

import subprocess

import pytest
from pyspark.sql import functions as F

from tesseral.llm import common


class Cluster:
    """As much of a session as the search for the shared folder asks for."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)


def test_files_that_the_driver_cannot_see_are_no_empty_table(spark, monkeypatch):
    own = common._path

    class Elsewhere:
        def __init__(self, files):
            self.files = files

        def listStatus(self, folder):
            return [f for f in self.files.listStatus(folder) if not f.getPath().getName().startswith("part-")]

    monkeypatch.setattr(common, "_path", lambda s, p: (Elsewhere(own(s, p)[0]), own(s, p)[1]))
    with pytest.raises(RuntimeError, match="isn't shared"):
        common.cut(spark.range(3))


def test_tables_live_as_long_as_their_scope(spark):
    inside = lambda df: df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    there = lambda path: subprocess.run(["test", "-d", path]).returncode == 0
    with common.temporary(spark):
        with common.temporary(spark):
            a, b = (inside(common.cut(spark.range(3), keep=keep)) for keep in (False, True))
            assert there(a) and there(b)
        assert not there(a) and there(b)
        c = inside(common.cut(spark.range(3), keep=True))
    assert not there(b) and there(c)
    common.release(spark)
    assert not there(c)


def test_empty_tables_are_written_and_read(spark):
    assert common.cut(spark.range(0).withColumn("x", F.lit("a"))).columns == ["id", "x"]
