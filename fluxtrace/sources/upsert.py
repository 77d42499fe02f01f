"""Tables that are created or loaded, and upserts by key, as snapshots that are committed last.

A table's folder holds whole snapshots and numbered commits, small files that name a snapshot and its
schema.  The last commit that is whole counts.  An upsert writes a new snapshot, then its commit, which
two writers can't both create; then snapshots before the last two go.  A crash between any two
steps leaves the table as it was before or after.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARTIFACTS = "filecode string, intervals array<struct<start: double, stop: double>>"
SNIFFS = "subject string, grp string, odor string, n int, stim struct<start: double, stop: double>, sniffs array<struct<start: double, stop: double>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    fs, target = _place(spark, path)
    return fs.exists(target)


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Hadoop knows them."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


@dataclass(frozen=True)
class Commit:
    number: int
    snapshot: str
    schema: StructType


def _commits(spark: SparkSession, path: str) -> tuple[int, list[Commit]]:
    """The highest number that a commit has, and the whole commits, the last first; one that was cut short, or whose snapshot is gone, is none."""
    fs, folder = _place(spark, f"{path}/_commits")
    if not fs.exists(folder):
        return 0, []
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
    found, top = [], 0
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if not name.isdigit():
            continue
        top = max(top, int(name))
        stream = fs.open(status.getPath())
        try:
            said = json.loads(read(stream, "UTF-8"))
            if exists(spark, f"{path}/{said['snapshot']}"):
                found.append(Commit(int(name), said["snapshot"], StructType.fromJson(said["schema"])))
        except ValueError:
            pass
        finally:
            stream.close()
    return top, sorted(found, key=lambda c: -c.number)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table as last committed; one written before there were commits is read as it is."""
    _, commits = _commits(spark, path)
    return spark.read.schema(commits[0].schema).parquet(f"{path}/{commits[0].snapshot}") if commits else spark.read.parquet(path)


def _commit(spark: SparkSession, path: str, snapshot: str, schema: StructType) -> None:
    """Makes a snapshot the table, as the next number; another writer's commit of that number is an error."""
    top, _ = _commits(spark, path)
    fs, file = _place(spark, f"{path}/_commits/{top + 1:012d}")
    out = fs.create(file, False)
    out.write(json.dumps({"snapshot": snapshot, "schema": schema.jsonValue()}).encode())
    out.close()


def _write(spark: SparkSession, path: str, frame: DataFrame) -> str:
    """Writes a snapshot and returns its name; no commit names it yet."""
    snapshot = f"snapshot-{uuid.uuid4().hex}"
    frame.write.parquet(f"{path}/{snapshot}")
    return snapshot


def tidy(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all but the last snapshots: earlier ones, and those that a crash left without a commit.

    A reader that began before the last ``keep`` commits, and a writer that is at work, lose theirs.
    """
    _, commits = _commits(spark, path)
    if not commits:
        return
    named = {c.snapshot for c in commits[:keep]}
    fs, folder = _place(spark, path)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("snapshot-") and name not in named:
            fs.delete(status.getPath(), True)


def create_or_load(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at a path, with the columns of the schema that it lacks as nulls; an empty one, which is committed there, if there is none."""
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        # What the earlier layout left where it ended between two renames.
        fs, target = _place(spark, path)
        fs.rename(_place(spark, f"{path}.old")[1], target)
    wanted = spark.createDataFrame([], schema)
    if not exists(spark, path) or not (_commits(spark, path)[1] or _plain(spark, path)):
        _commit(spark, path, _write(spark, path, wanted), wanted.schema)
    known = load(spark, path)
    return known.withColumns({f.name: F.lit(None).cast(f.dataType) for f in wanted.schema if f.name not in known.columns})


def _plain(spark: SparkSession, path: str) -> bool:
    """Whether a folder has Parquet files of its own, beside no commit."""
    fs, folder = _place(spark, path)
    return any(s.isFile() and s.getPath().getName().endswith(".parquet") for s in fs.listStatus(folder))


def merged(known: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """All newer rows, and the known rows without their keys; a null in a key is a value like others.

    Columns of either side are kept; the other side's rows have nulls there.
    """
    replaced = newer.select(*(F.col(k).alias(f"_new_{i}") for i, k in enumerate(keys))).distinct()
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_new_{i}")) for i, k in enumerate(keys)))
    return known.join(replaced, same, "left_anti").unionByName(newer, allowMissingColumns=True)


def upsert(spark: SparkSession, path: str, newer: DataFrame, keys: list[str]) -> None:
    """Merges newer rows into the table at a path, which takes on their new columns and keeps its own."""
    rows = merged(create_or_load(spark, path, newer.schema), newer, keys)
    _commit(spark, path, _write(spark, path, rows), rows.schema)
    tidy(spark, path)
