"""Session helpers: table access, shared scratch tables and lineage cuts.

Everything that has to outlive a stage goes to the folder named by
``spark.checkpoint.dir`` (shared by driver and executors).  Only a local master
may do without that setting: there driver and executors are one process, so a
temporary folder is shared too.  On a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()
_HELD: dict[int, tuple[SparkSession, str]] = {}


def ship(spark: SparkSession | None = None) -> None:
    """Gives Python workers this package, wherever the driver was started.

    To be called before a Python function is wrapped, as that fixes what it takes along.
    """
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        archive = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom.zip"
        package = Path(__file__).resolve().parent
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, Path("sparkloom") / f.relative_to(package))
        spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _FALLBACK[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/sparkloom/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


#: A task that makes a table reads so many bytes at most, and a file holds so many rows: a table of few bytes a row
#: would else give a task, and its hash tables, rows that grow with the input.
TASK_BYTES, FILE_ROWS = 8 << 20, 1_000_000


@contextmanager
def _small_tasks(df: DataFrame) -> Iterator[None]:
    """Settings for the making of ``df``: ``TASK_BYTES`` a task of a scan or a shuffle, and shuffle partitions enough for these."""
    conf, leaves = df.sparkSession.conf, df._jdf.queryExecution().analyzed().collectLeaves()
    files = [leaves.apply(i) for i in range(leaves.size())]
    read = sum(int(str(f.stats().sizeInBytes())) for f in files if f.nodeName().startswith("LogicalRelation"))
    size = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    parts, sizes = "spark.sql.shuffle.partitions", ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: conf.get(n) for n in (parts, *sizes)}
    try:
        conf.set(parts, str(max(int(before[parts]), -(-read // TASK_BYTES))))
        for n in sizes:
            conf.set(n, str(min(size(before[n]), TASK_BYTES)))
        yield
    finally:
        for n, value in before.items():
            conf.set(n, value)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage without tying the rows to any executor: a lost executor
    only repeats the tasks that were running on it.
    """
    spark = df.sparkSession
    ship(spark)
    path = shared_path(spark, label)
    writer = df.write.option("maxRecordsPerFile", FILE_ROWS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _small_tasks(df):
        writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _HELD[id(back)] = (spark, path)
    weakref.finalize(back, _HELD.pop, id(back), None)
    return back


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its scan has fewer tasks than those, as heavy work per row needs it.

    What moves is one scan split for each core at most, so a large table never does.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(2 * cores) if tasks < cores else df


def release(df: DataFrame) -> None:
    """Removes the files of a table from :func:`materialize` that no plan reads any more."""
    at = _HELD.pop(id(df), None)
    if at is not None:
        drop_path(*at)
        if at in _WRITTEN:
            _WRITTEN.remove(at)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the JVM may be gone already
            return
