"""Intermediate tables in the cluster's shared folder.

A staged table cuts lineage, is read back by any executor (so a lost executor costs a re-read, not
a re-run of the whole pipeline) and gives the optimizer real sizes to choose joins by.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="kinfold-")
    return _own_folders[app]


class Workspace:
    """One run's staged tables, in a folder of their own."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.path = f"{folder or shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self._numbers = itertools.count()
        self._paths: dict[int, str] = {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        path = f"{self.path}/{next(self._numbers):03d}-{name}"
        df.write.parquet(path)
        staged = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(staged)] = path
        return staged

    def release(self, staged: DataFrame) -> None:
        """Delete one staged table; DataFrames built on it stop working."""
        self._delete(self._paths.pop(id(staged)))

    def drop(self) -> None:
        """Delete all staged tables; DataFrames built on them stop working."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
