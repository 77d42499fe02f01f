"""Vendor CSV recordings: a line of vendor text, a header, Latin-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks

RAW = {"Time(s)": "time_s", "AIn-1": "ain1", "AIn-4": "ain4", "DI/O-1": "gate405", "DI/O-2": "gate470", "DI/O-3": "camera"}
# The columns of the files that each step writes.
DEINTERLEAVED = {"Time(s)": "time_s", "405 Deinterleaved": "ctrl", "470 Deinterleaved": "sig"}
TRACE = {"Time(s)": "time_s", "405 dFF": "ctrl", "470 dFF": "sig", "Denoised dFF": "denoised"}
ALIGNED = {"Time(s)": "time_s", "Denoised dFF": "denoised", "405nm dFF": "ctrl", "470nm dFF": "sig"}


_TIME = "Time(s)"


def _lines(spark: SparkSession, path: str, encoding: str, n: int) -> DataFrame:
    """(_file, _at, _line, c0 ...): the fields of all lines; _at and _line give their order in the file."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    rows = spark.read.schema(schema).option("encoding", encoding).csv(path)
    return rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_line"), *rows.columns)


def headers(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", time: str | None = _TIME) -> DataFrame:
    """(_file, rec, names): the header of each file of a path, the first line that names the time; without a name for it,
    the first line.  A file without one is an error.

    rec is the file's name up to its first dot; where several files have that name, their folder stands
    before it, and where that isn't enough, the whole path.
    """
    text = spark.read.option("encoding", encoding).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_place"), "value")
    names = F.transform(F.split("value", ","), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1")))
    named = F.lit(True) if time is None else F.array_contains(names, time)
    found = rows.groupBy("_file").agg(F.min_by(F.when(named, names), F.when(named, F.col("_place"))).alias("names"))
    if without := found.where("names is null").head(1):
        raise ValueError(f"no line of {without[0]._file} names {time}")
    parts = F.split("_file", "/")
    name = F.substring_index(F.element_at(parts, -1), ".", 1)
    found = found.withColumn("_name", name).withColumn("_longer", F.concat_ws("/", F.element_at(parts, -2), name))
    alone = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    return found.select("_file", F.when(alone("_name"), F.col("_name")).when(alone("_longer"), F.col("_longer")).otherwise(F.col("_file")).alias("rec"), "names")


def _read(spark: SparkSession, path: str, encoding: str, found: DataFrame) -> DataFrame:
    """(rec, _at, _line, names, fields): the lines of all files, each with its own file's header."""
    widest = found.agg(F.max(F.size("names"))).head()[0] or 1
    rows = _lines(spark, path, encoding, widest)
    return rows.select("_file", "_at", "_line", F.array(*(f"c{i}" for i in range(widest))).alias("fields")).join(found, "_file")


def _field(name: str) -> Column:
    """The number in a line's field of that name; NaN, text and a field that the file lacks are null."""
    at = F.array_position("names", name)
    return F.nanvl(F.when(at > 0, F.get("fields", (at - 1).cast("int"))).try_cast("double"), F.lit(None).cast("double"))


def _numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with idx, in the order of their file; a part of a file is a block, and no task numbers a whole one."""
    counted = blocks.Carried(rows, order=("_at", "_line"), block=F.col("_at")).total("_k", F.lit(1).cast("long")).frame()
    return counted.select("rec", (F.col("_k") - 1).alias("idx"), *columns)


def read_recording(spark: SparkSession, path: str, columns: dict[str, str] | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """(rec, idx, the columns that any header has): one recording for each file of the path.

    Each file's own header says where its columns stand; what it lacks is null.  Lines whose time is
    no number, which the vendor's line and the header are, are left out.  NaN becomes null.  idx
    counts in the order of the file.  Files are read twice, the first time for their headers.
    """
    found = headers(spark, path, encoding)
    there = {r.name for r in found.select(F.explode("names").alias("name")).distinct().collect()}
    wanted = {n: to for n, to in (columns or RAW).items() if n in there}
    rows = _read(spark, path, encoding, found).select("rec", "_at", "_line", *(_field(n).alias(to) for n, to in wanted.items()))
    return _numbered(rows.where(F.col("time_s").isNotNull()), list(wanted.values()))


def read_behaviour(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(rec, idx, time_s, behaviour, level) of scored files: the time first, then a column for each behaviour.

    A file's first line is its header; behaviours that it hasn't have no rows.
    """
    found = headers(spark, path, encoding, None)
    rows = _read(spark, path, encoding, found)
    rows = rows.select("rec", "_at", "_line", "names", "fields", F.get("fields", F.lit(0)).try_cast("double").alias("time_s")).where(F.col("time_s").isNotNull())
    pairs = F.slice(F.arrays_zip(F.col("names").alias("behaviour"), F.slice("fields", F.lit(1), F.size("names")).alias("level")), F.lit(2), F.size("names"))
    return _numbered(rows, ["time_s", F.explode(pairs).alias("_p")]).select("rec", "idx", "time_s", "_p.behaviour", F.col("_p.level").try_cast("int").alias("level"))


def read_aligned(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame]:
    """The trace (rec, idx, time_s, denoised, ctrl, sig) and the states (rec, idx, behaviour, level) of aligned frames.

    States are the columns whose name is none of ``ALIGNED``, wherever they stand in a file; a column of
    row numbers, whose name is empty, is none.
    """
    found = headers(spark, path, encoding)
    there = {r.name for r in found.select(F.explode("names").alias("name")).distinct().collect()}
    trace = [to for name, to in ALIGNED.items() if name in there]
    rows = read_recording(spark, path, ALIGNED, encoding)
    lines = _read(spark, path, encoding, found).withColumn("time_s", _field(_TIME)).where(F.col("time_s").isNotNull())
    each = F.explode(F.filter(F.arrays_zip(F.col("names").alias("behaviour"), F.slice("fields", F.lit(1), F.size("names")).alias("level")), lambda p: (p.behaviour != "") & ~p.behaviour.isin(*ALIGNED)))
    states = _numbered(lines, [each.alias("_p")])
    return rows.select("rec", "idx", *trace), states.select("rec", "idx", "_p.behaviour", F.col("_p.level").try_cast("double").cast("int").alias("level"))


def shown_names(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The frame's columns under the names that files show, such as those of ``ALIGNED``."""
    return frame.withColumnsRenamed({to: name for name, to in columns.items()})


def write_csv(frame: DataFrame, path: str, index: bool = False) -> None:
    """CSV with a header; idx only if it is asked for."""
    (frame if index or "idx" not in frame.columns else frame.drop("idx")).write.mode("overwrite").option("header", True).csv(path)
