import glob

import pytest
from pyspark.sql import functions as F

from sparkloom import runtime


def test_tables_are_released(spark):
    t = runtime.materialize(spark.range(5), "release-test")
    path = t.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert glob.glob(path) and t.count() == 5
    runtime.release(t)
    assert not glob.glob(path)
    runtime.release(t)  # a second time does nothing


def test_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_rows_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    """A file of a table and a task that reads it hold no more the larger the input is."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    monkeypatch.setattr(runtime, "FILE_ROWS", 1000)
    monkeypatch.setattr(runtime, "TASK_BYTES", 4096)
    t = runtime.materialize(spark.range(10_000).coalesce(1), "bounded-test")
    assert len(t.inputFiles()) == 10
    seen = runtime.materialize(t.select("id", F.spark_partition_id().alias("p")), "bounded-test")
    assert seen.groupBy("p").count().agg(F.max("count")).first()[0] == 1000
    assert [spark.conf.get(n) for n in names] == before
