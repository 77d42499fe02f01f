"""Transients: peaks over a threshold of median and MAD, counted by recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import space_peaks
from .smooth import local_maxima, median_deviation

THRESHOLDS = {"one_MAD": 1.0, "two_MAD": 2.0}


def thresholds(samples: DataFrame, channel: str, threshold: str = "one_MAD") -> DataFrame:
    """(rec, height_least): median plus one or two deviations."""
    if threshold not in THRESHOLDS:
        raise ValueError(f"threshold must be one of {sorted(THRESHOLDS)}")
    return median_deviation(samples, channel).select("rec", (F.col("median") + THRESHOLDS[threshold] * F.col("mad")).alias("height_least"))


def peaks(samples: DataFrame, channel: str, rate: float, threshold: str = "one_MAD") -> DataFrame:
    """(rec, idx, height): maxima over the threshold, spaced by half a second."""
    high = local_maxima(samples, channel).join(thresholds(samples, channel, threshold), "rec").where("height >= height_least")
    return space_peaks(high.select("rec", "idx", "height"), rate)


def transients(samples: DataFrame, channel: str, rate: float, threshold: str = "one_MAD", time: str = "time_s") -> DataFrame:
    """(rec, n_peaks, frequency, mean_height): peaks, peaks a second of the span, and their mean height."""
    span = samples.groupBy("rec").agg((F.max(time) - F.min(time)).alias("span"))
    found = peaks(samples, channel, rate, threshold).groupBy("rec").agg(F.count("*").alias("n"), F.avg("height").alias("mean_height"))
    rows = span.join(found, "rec", "left").withColumn("n_peaks", F.coalesce("n", F.lit(0).cast("long")))
    return rows.select("rec", "n_peaks", (F.col("n_peaks") / F.nullif("span", F.lit(0.0))).alias("frequency"), "mean_height")


def mark_peaks(samples: DataFrame, found: DataFrame) -> DataFrame:
    """Adds peak: 1 at the peaks, 0 elsewhere."""
    return samples.join(found.select("rec", "idx", F.lit(1).alias("peak")), ["rec", "idx"], "left").withColumn("peak", F.coalesce("peak", F.lit(0)))
