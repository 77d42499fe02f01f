"""Filling and masking missing samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks


def interpolate(samples: DataFrame, channel: str, out: str, size: int = blocks.BLOCK) -> DataFrame:
    """Adds out: the channel with gaps filled linearly by sample number, both ends extended flat."""
    known = F.when(F.col(channel).isNotNull(), F.struct("idx", F.col(channel).cast("double").alias("v")))
    rows = blocks.Carried(samples, size=size).last("_a", known).next("_b", known).frame()
    share = (F.col("idx") - F.col("_a.idx")) / F.nullif(F.col("_b.idx") - F.col("_a.idx"), F.lit(0))
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    return rows.withColumn(out, F.coalesce(F.col(channel).cast("double"), between, F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")


def mean_pad(samples: DataFrame, channel: str, out: str) -> DataFrame:
    """Adds out: the channel with the recording's mean for what is missing."""
    rows = blocks.with_totals(samples, ("rec",), _mean=F.avg(channel))
    return rows.withColumn(out, F.coalesce(F.col(channel), "_mean")).drop("_mean")


def zero_to_null(samples: DataFrame, *columns: str) -> DataFrame:
    """Zeros of the columns become null."""
    return samples.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in columns})
