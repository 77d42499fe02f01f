"""Manifests: which recordings there are, which are done, which sessions they have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import filecode, session_code


def session_manifest(protocol: DataFrame, subjects: DataFrame, task: str) -> DataFrame:
    """(rec, subject, batch, session, code, filecode): the sessions of a task for each subject of its batches.

    protocol: (task, batch, sessions), sessions separated by commas.
    """
    sessions = protocol.where(F.col("task") == task).select("batch", F.explode(F.split("sessions", ",")).alias("session")).distinct()
    rows = subjects.join(sessions, "batch")
    return rows.select("rec", "subject", "batch", "session", session_code(F.col("session")).alias("code"), filecode(F.lit(task), F.col("session"), F.col("subject")).alias("filecode"))


def waiting(inputs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Inputs whose key has no output yet."""
    return inputs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files below a folder, without their contents."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def folders(names: DataFrame, least: int = 2) -> DataFrame:
    """(folder, n): the folders that hold at least ``least`` of the files, such as the one that's always there and an output."""
    return names.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def protocol_value(protocol: DataFrame, task: str, batch: str, column: str) -> str:
    """A column of the protocol's row for a task and batch; an error if there is none."""
    found = protocol.where((F.col("task") == task) & (F.col("batch") == batch)).select(column).head(1)
    if not found or found[0][0] is None:
        raise ValueError(f"the protocol has no {column} for task {task} and batch {batch}")
    return found[0][0]


def data_folder(protocol: DataFrame, base: str, task: str, batch: str) -> str:
    """Where a batch's recordings of a task lie: base, batch and the protocol's data_path."""
    return f"{base}/{batch}/{protocol_value(protocol, task, batch, 'data_path')}"


def lay_out(spark: SparkSession, base: str, task: str, sessions: list[str]) -> list[str]:
    """Makes a folder for each session of a task, on whatever file system base names; those there are stay."""
    context = spark.sparkContext
    made = [f"{base}/{task}/{session}" for session in sessions]
    for folder in made:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(path)
    return made


def scored_files(names: DataFrame) -> DataFrame:
    """The files of scored behaviour, to be read where they lie."""
    return names.where(F.col("name").startswith("behav_"))
