"""Session settings and shared scratch storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan here relies on.  Wall-clock columns are
# timestamp_ntz; UTC makes the conversions from epoch values and ISO strings
# independent of the machine's zone.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows handed to a Python worker at a time; texts can be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the library needs to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench.

    Small shuffle partitions are not merged below 256 KB, or all of a test
    table's work would end up on one core.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trainlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def case_sensitive(spark: SparkSession) -> AbstractContextManager[None]:
    """Tell names apart by case, as the export files do, while the block runs."""
    return _held(spark, "spark.sql.caseSensitive", "true")


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """What is executed inside the block removes its shuffle files when it ends.

    Otherwise they stay until the driver happens to collect its garbage, and
    those of many writes lie on the disks together.
    """
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def partly_partitioned(spark: SparkSession) -> AbstractContextManager[None]:
    """Joins executed inside the block may use a partitioning by some of their keys instead of shuffling again."""
    return _held(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever used with a ``local`` master.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    # The folder is this process's own.
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so later reads see one fixed layout."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
