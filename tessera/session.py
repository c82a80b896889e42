"""Session settings and shared scratch storage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings for a local run; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}

#: The setting by which a query's shuffle files go when the query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SHUFFLES = "spark.sql.shuffle.partitions"
#: Rows that a partition of a shuffle should have, so that a task's memory does not grow with the table.
ROWS_A_PARTITION = 1_000_000
#: As many narrow rows are sent to every executor; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000

#: Tables written since :func:`materialize_alone` began, if it did.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def local_session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session for tests and benchmarks."""
    return SparkSession.builder.master(master).config(map={**LOCAL_CONF, **conf}).getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset, as in tests on one
    machine, a temporary folder is made and set.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        named = context.getCheckpointDir()
    return named


def materialize(df: DataFrame, tag: str, partitions: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation. Shuffle files of the
    write are of no more use once it is done, and Spark is asked to drop them then. ``partitions``
    is the least number of partitions of its shuffles.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name) for name in (DROP_SHUFFLES, SHUFFLES)}
    spark.conf.set(DROP_SHUFFLES, "true")
    if partitions > int(before[SHUFFLES]):
        spark.conf.set(SHUFFLES, str(partitions))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    if _WRITTEN.get() is not None:
        _WRITTEN.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def enough_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of ``rows``, at least the session's own number."""
    return max(int(spark.conf.get(SHUFFLES)), -(-rows // ROWS_A_PARTITION))


def small(df: DataFrame, width: int = 1) -> DataFrame:
    """``df``, a table that is cheap to count, marked for broadcast if it has few rows of ``width`` values each."""
    return F.broadcast(df) if df.count() * width <= MOST_BROADCAST else df


def materialize_alone(build: Callable[[], DataFrame], tag: str) -> DataFrame:
    """Write what ``build`` returns, as :func:`materialize` does, and delete all tables written on the way.

    What was built must not hold on to frames that are read later: only the result stays.
    """
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        out = materialize(build(), tag)
    finally:
        _WRITTEN.reset(token)
    for path in written[:-1]:
        _delete(out.sparkSession, path)
    if _WRITTEN.get() is not None:
        _WRITTEN.get().append(written[-1])
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def listing(spark: SparkSession, *paths: str) -> tuple:
    """Path, size and time of the last change of files or folders; it differs once one of them was changed."""
    out = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((path, store.getContentSummary(at).getLength(), store.getFileStatus(at).getModificationTime()))
    return tuple(out)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and that nothing is going to read any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if re.fullmatch(r".+-[0-9a-f]{32}", folder.getName()):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
