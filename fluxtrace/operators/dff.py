"""Relative change of a signal, by its mean or by a linear fit of its control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks


def dff_mean(samples: DataFrame, *channels: str) -> DataFrame:
    """Adds <channel>_dff = (x - mean) / mean * 100 by recording; nulls are skipped, a mean of 0 gives null."""
    rows = blocks.with_totals(samples, ("rec",), **{f"_mean_{c}": F.avg(c) for c in channels})
    change = {f"{c}_dff": (F.col(c) - F.col(f"_mean_{c}")) / F.nullif(F.col(f"_mean_{c}"), F.lit(0.0)) * 100 for c in channels}
    return rows.withColumns(change).drop(*(f"_mean_{c}" for c in channels))


def fit_terms(samples: DataFrame, ctrl: str = "ctrl", sig: str = "sig", keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """(keys, slope, intercept) of the least-squares line signal ~ control; pairs with a null are skipped."""
    return samples.groupBy(*keys).agg(F.regr_slope(sig, ctrl).alias("slope"), F.regr_intercept(sig, ctrl).alias("intercept"))


def dff_fit(samples: DataFrame, ctrl: str = "ctrl", sig: str = "sig") -> DataFrame:
    """Adds fit (the fitted control) and denoised = (signal - fit) / fit * 100."""
    rows = blocks.with_totals(samples, ("rec",), _slope=F.regr_slope(sig, ctrl), _intercept=F.regr_intercept(sig, ctrl))
    rows = rows.withColumn("fit", F.col("_slope") * F.col(ctrl) + F.col("_intercept")).drop("_slope", "_intercept")
    return rows.withColumn("denoised", (F.col(sig) - F.col("fit")) / F.nullif("fit", F.lit(0.0)) * 100)
