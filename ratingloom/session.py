"""Staged tables: results written to shared storage to cut lineage.

Iterative jobs need their state cut from the plan of the previous step. The state
is written as parquet under the cluster's checkpoint folder, so it outlives lost
executors, keeps column pruning, and is read back with known file sizes (which is
what lets Spark decide by size whether a join side may be broadcast).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="ratingloom-")
    return _local_root


class Folder:
    """Small files under a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self.path = path
        root = self._path("")
        self._system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def uri(self) -> str:
        """The folder with its file system, as tasks need it that open files by themselves."""
        return self._system.makeQualified(self._path("")).toString()

    def names(self, name: str = "") -> list[str]:
        """Names of what lies there; none if it is missing."""
        if not self._system.exists(self._path(name)):
            return []
        return [entry.getPath().getName() for entry in self._system.listStatus(self._path(name))]

    def read(self, name: str) -> str | None:
        """The text of a file, or None if it is missing."""
        if not self._system.exists(self._path(name)):
            return None
        stream = self._system.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file whole or not at all; one that is there already is an error."""
        folder, _, base = name.rpartition("/")
        beside = f"{folder}/.{base}-{uuid.uuid4().hex}"
        stream = self._system.create(self._path(beside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._system.exists(self._path(name)) or not self._system.rename(self._path(beside), self._path(name)):
            self._system.delete(self._path(beside), False)
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        self._system.delete(self._path(name), True)


class StagedTable:
    """A DataFrame backed by files this process wrote, with a way to drop them."""

    def __init__(self, df: DataFrame, path: str):
        self.df = df
        self.path = path

    def drop(self) -> None:
        Folder(self.df.sparkSession, self.path).delete("")


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, root: str | None = None) -> StagedTable:
    """Write ``df`` to the shared folder, or under ``root``, and return the table read back from it."""
    spark = df.sparkSession
    path = f"{root or shared_root(spark)}/ratingloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    columns = df.columns if not partition_by else (
        [c for c in df.columns if c not in partition_by] + partition_by)
    return StagedTable(spark.read.schema(df.select(*columns).schema).parquet(path), path)


def task_slots(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
