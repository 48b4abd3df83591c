"""Parquet tables of the lake: writing, reading, counting.

A table is a folder of versions and a manifest that names the current one.  A
version is written in full before the manifest is replaced by one rename, so a
build that fails leaves the table as it was, and a reader that has begun keeps
its files: the version before the current one stays.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.summary import row_counts
from ..session import shuffles_dropped

LAYERS = ("raw", "staging", "intermediate", "marts")


def dataset_path(base: str, demo: bool | None = None) -> str:
    """Folder of the personal or the demo dataset; the environment flag decides when not told."""
    if demo is None:
        demo = os.getenv("USE_SYNTHETIC_DATA", "").lower() == "true"
    return os.path.join(base, "demo" if demo else "personal")


def table_path(lake: str, layer: str, name: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; valid: {LAYERS}")
    return os.path.join(lake, layer, name)


class _Folder:
    """A table's folder in whatever store Spark reaches it by."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = path
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(os.path.join(self._path, name) if name else self._path)

    def manifest(self) -> dict[str, str | None] | None:
        """``current`` and ``previous`` version, None without a manifest."""
        at = self._at(MANIFEST)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put_manifest(self, versions: dict[str, str | None]) -> None:
        draft = self._at(f"{MANIFEST}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(json.dumps(versions).encode())
        finally:
            stream.close()
        # One rename that replaces what is there.
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(context.makeQualified(draft), context.makeQualified(self._at(MANIFEST)), options)

    def remove(self, version: str) -> None:
        self._fs.delete(self._at(version), True)


# Spark passes over names that begin with an underscore.
MANIFEST = "_current.json"


def write_table(
    df: DataFrame,
    lake: str,
    layer: str,
    name: str,
    cluster_by: Sequence[str] = (),
    partitions: int | None = None,
    filtered: Sequence[str] = (),
) -> DataFrame:
    """Create or replace a table and return it as read back.

    ``cluster_by`` lays the rows out by range (a hot value spreads over several
    files when a unique column is listed last), so that date filters skip files.
    ``filtered`` names columns that get a Bloom filter, for questions about one
    value.  The table as it was stays readable until the new one is complete,
    and for running readers until the next replacement.
    """
    path = table_path(lake, layer, name)
    if cluster_by:
        ranged = df.repartitionByRange(partitions, *cluster_by) if partitions else df.repartitionByRange(*cluster_by)
        df = ranged.sortWithinPartitions(*cluster_by)
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    folder = _Folder(spark, path)
    before = folder.manifest()
    writer = df.write
    for column in filtered:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    try:
        with shuffles_dropped(spark):
            writer.parquet(os.path.join(path, version))
    except BaseException:
        # Only this attempt's own folder.
        folder.remove(version)
        raise
    last = before["current"] if before else None
    folder.put_manifest({"current": version, "previous": last})
    if before and before["previous"]:
        folder.remove(before["previous"])
    return spark.read.parquet(os.path.join(path, version))


@contextmanager
def steps(spark: SparkSession, lake: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Inside the block, a function that writes a step of a plan and returns it as read back.

    The shuffle files of a step go when it is written, and the steps when the block ends.
    """
    folder = table_path(lake, "intermediate", f"steps-{uuid.uuid4().hex}")

    def written(df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(folder, name)
        with shuffles_dropped(spark):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield written
    finally:
        # Only this block's own folder.
        _Folder(spark, folder).remove("")


def read_table(spark: SparkSession, lake: str, layer: str, name: str) -> DataFrame:
    """The current version; a folder without a manifest is read as it is."""
    path = table_path(lake, layer, name)
    versions = _Folder(spark, path).manifest()
    return spark.read.parquet(os.path.join(path, versions["current"]) if versions else path)


def read_tables(spark: SparkSession, lake: str, layer: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Those of the named tables that exist."""
    found = {}
    for name in names:
        try:
            found[name] = read_table(spark, lake, layer, name)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def count_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of every table, by name."""
    return row_counts(tables).orderBy("table_name")
