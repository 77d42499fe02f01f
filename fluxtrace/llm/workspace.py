"""Intermediate tables that cut lineage and outlive executors.

Tables are Parquet files below the folder that the session names in
``spark.checkpoint.dir``, which the driver and all executors share.  Only a
local session without that setting (tests) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files as soon as it ends; its result is a table by then.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder as a URI or path; it raises on a cluster without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="fluxtrace-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Lists of the folders that were opened within each ``scratch`` block that runs.
_WATCHED: list[list[str]] = []


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of whatever file system it names."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Operators' tables that are made inside are deleted at the end; save what is wanted of their results before."""
    opened: list[str] = []
    _WATCHED.append(opened)
    try:
        yield
    finally:
        _WATCHED.remove(opened)
        for folder in opened:
            delete(spark, folder)


class Workspace:
    """Named tables of one operator run, in a fresh subfolder.

    An operator drops what its result doesn't read; the rest goes with the ``scratch`` block around
    it, or stays with the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if _WATCHED:
            _WATCHED[-1].append(self.folder)

    def save(self, frame: DataFrame, name: str, rows_per_batch: int = 500) -> DataFrame:
        """Writes the frame and returns a reader of what was written.

        rows_per_batch: what Python functions in its plan get at once, at most.
        """
        path = f"{self.folder}/{name}"
        settings = {SHUFFLE_CLEANUP: "true", BATCH: str(rows_per_batch)}
        before = {key: self.spark.conf.get(key, None) for key in settings}
        for key, value in settings.items():
            self.spark.conf.set(key, value)
        try:
            frame.write.mode("overwrite").parquet(path)
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            delete(self.spark, f"{self.folder}/{name}")

    def remove(self) -> None:
        """Deletes all tables."""
        delete(self.spark, self.folder)
