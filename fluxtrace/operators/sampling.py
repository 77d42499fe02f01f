"""Sampling: rates, time vectors, cropping, decimation, nearest-index resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def by_sample(*keys: str) -> Window:
    """The window of a recording in the order of its samples."""
    return Window.partitionBy(*(keys or ("rec",))).orderBy("idx")


def sample_rate(samples: DataFrame, time: str = "time_s") -> DataFrame:
    """(rec, n, samplerate): all samples over the span of the times that are there; null for a span of 0."""
    span = F.max(time) - F.min(time)
    return samples.groupBy("rec").agg(F.count("*").alias("n"), (F.count("*") / F.nullif(span, F.lit(0.0))).alias("samplerate"))


def time_vector(samples: DataFrame, rate: float, time: str = "time_s", size: int = blocks.BLOCK) -> DataFrame:
    """(rec, i, t): a uniform vector from 0 to the last but one time rounded up, i of int(duration * rate) + 1 points."""
    last = samples.groupBy("rec").agg((F.max("idx") - 1).alias("idx"))
    duration = samples.select("rec", "idx", time).join(last, ["rec", "idx"]).select("rec", F.ceil(time).cast("double").alias("duration"))
    points = duration.withColumn("n", F.floor(F.col("duration") * rate).cast("long")).withColumn("points", F.col("n") + 1)
    grid = blocks.counted(points, "points", "i", size)
    return grid.select("rec", "i", F.coalesce(F.col("i") * F.col("duration") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("t"))


def renumber(samples: DataFrame, keys: tuple[str, ...] = ("rec",), size: int = blocks.BLOCK) -> DataFrame:
    """Samples numbered anew from 0, without gaps."""
    return blocks.numbered(samples.drop("_block"), "_k", keys, size).withColumn("idx", F.col("_k") - 1).drop("_k")


def crop(samples: DataFrame, first: int, size: int = blocks.BLOCK) -> DataFrame:
    """Samples from number ``first`` on, numbered anew from 0."""
    return renumber(samples.where(F.col("idx") >= first), size=size)


def decimate(samples: DataFrame, step: int = 600) -> DataFrame:
    """Every ``step``-th sample, the first included; numbers stay as they are (see ``renumber``)."""
    return samples.where(F.col("idx") % step == 0)


def resample_nearest(fast: DataFrame, slow: DataFrame, value: str, size: int = blocks.BLOCK) -> DataFrame:
    """(rec, j, idx, value): for each of the M samples of ``slow`` the one of N of ``fast`` at
    round(j * (N - 1) / (M - 1)), halves to even."""
    sizes = fast.groupBy("rec").agg(F.count("*").alias("n")).join(slow.groupBy("rec").agg(F.count("*").alias("m")), "rec")
    grid = blocks.counted(sizes, "m", "j", size)
    at = F.rint(F.col("j") * (F.col("n") - 1) / F.nullif(F.col("m") - 1, F.lit(0))).cast("long")
    grid = grid.select("rec", "j", F.coalesce(at, F.lit(0).cast("long")).alias("idx"))
    return grid.join(fast.select("rec", "idx", value), ["rec", "idx"])


def camera_window(samples: DataFrame, gate: Column, time: str = "time_s") -> DataFrame:
    """(rec, t_start, t_stop): the times of the first and last sample with the gate open, cut to tenths."""
    on = samples.where(gate).groupBy("rec").agg(F.min_by(time, "idx").alias("a"), F.max_by(time, "idx").alias("b"))
    cut = lambda c: (F.col(c) * 10).cast("long") / F.lit(10.0)
    return on.select("rec", cut("a").alias("t_start"), cut("b").alias("t_stop"))


def camera_start(samples: DataFrame, start: float, time: str = "time_s", required: bool = False) -> DataFrame:
    """(rec, idx): the first sample whose time rounds, halves to even, to ``start`` in tenths.

    A recording without one has no row, or, if it is required, is an error.
    """
    found = samples.where(F.rint(F.col(time) * 10) == round(start * 10)).groupBy("rec").agg(F.min("idx").alias("idx"))
    if required and (without := samples.select("rec").join(found, "rec", "left_anti").head(1)):
        raise ValueError(f"recording {without[0].rec} has no sample at {start} s")
    return found
