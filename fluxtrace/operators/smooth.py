"""Smoothing, outlier replacement, detrending, robust spread, local maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def moving_average(samples: DataFrame, channel: str, width: int, out: str, size: int = blocks.BLOCK) -> DataFrame:
    """Adds out: the mean of the last ``width`` samples, fewer at the start; nulls are skipped.  Numbers have no gaps."""
    rows = blocks.haloed(samples, width - 1, 0, size)
    return rows.withColumn(out, F.avg(channel).over(blocks.in_block().rowsBetween(1 - width, 0))).where("_own").drop("_block", "_own")


def hampel(samples: DataFrame, channel: str, out: str, half: int = 5, sigmas: float = 5.0, size: int = blocks.BLOCK) -> DataFrame:
    """Adds out: values further than sigmas * 1.4826 * MAD from the median of the window of
    2 * half + 1 samples become that median; the first and last ``half`` samples stay.  Numbers have no gaps."""
    frame = blocks.in_block().rowsBetween(-half, half)
    rows = blocks.haloed(samples, half, half, size).withColumn("_window", F.collect_list(channel).over(frame)).withColumn("_size", F.count("*").over(frame)).where("_own")
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    rows = rows.withColumn("_sorted", F.sort_array("_window"))
    rows = rows.withColumn("_median", middle("_sorted"))
    rows = rows.withColumn("_apart", F.sort_array(F.transform("_window", lambda v: F.abs(v - F.col("_median")))))
    rows = rows.withColumn("_mad", 1.4826 * middle("_apart"))
    odd = (F.col("_size") == 2 * half + 1) & (F.abs(F.col(channel) - F.col("_median")) > sigmas * F.col("_mad"))
    return rows.withColumn(out, F.when(odd, F.col("_median")).otherwise(F.col(channel))).drop("_block", "_own", "_window", "_size", "_sorted", "_median", "_apart", "_mad")


def detrend(samples: DataFrame, channel: str, out: str) -> DataFrame:
    """Adds out: the channel without its least-squares line over the sample number."""
    rows = blocks.with_totals(samples, ("rec",), _slope=F.regr_slope(channel, "idx"), _intercept=F.regr_intercept(channel, "idx"))
    return rows.withColumn(out, F.col(channel) - (F.col("_slope") * F.col("idx") + F.col("_intercept"))).drop("_slope", "_intercept")


#: Bins that a recording's values are counted in.
BINS = 1 << 16


def medians(values: DataFrame, bins: int = BINS) -> DataFrame:
    """(rec, median) of values (rec, v), the mean of the middle two of an even number; nulls don't count, and without a value there is none.

    Exact, by selection: a count in equal bins between a recording's least and greatest value finds those
    that hold the middle two, and only these bins' values are counted one by one.  An aggregate would hold all
    distinct values of a recording in one buffer; here a task holds a recording's bins, or one bin's values.
    """
    rows = values.select("rec", F.col("v").cast("double").alias("v")).where("v is not null")
    ends = rows.groupBy("rec").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    ends = ends.withColumn("first", F.floor((F.col("n") - 1) / 2)).withColumn("second", F.floor(F.col("n") / 2))
    share = (F.col("v") / 2 - F.col("lo") / 2) / F.nullif(F.col("hi") / 2 - F.col("lo") / 2, F.lit(0.0))
    rows = rows.join(ends, "rec").withColumn("bin", F.coalesce(F.least(F.floor(F.nanvl(share, F.lit(0.0)) * bins), F.lit(bins - 1)), F.lit(0)).cast("long"))
    counts = rows.groupBy("rec", "bin").agg(F.count("*").alias("c"), F.first("first").alias("first"), F.first("second").alias("second"))
    holds = lambda rank: (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("c"))
    counts = counts.withColumn("before", F.sum("c").over(Window.partitionBy("rec").orderBy("bin")) - F.col("c"))
    middle = counts.where(holds("first") | holds("second")).select("rec", "bin", F.col("before").alias("ahead"))
    each = rows.join(middle, ["rec", "bin"]).groupBy("rec", "bin", "v").agg(F.count("*").alias("c"), F.first("ahead").alias("ahead"), F.first("first").alias("first"), F.first("second").alias("second"))
    each = each.withColumn("before", F.col("ahead") + F.sum("c").over(Window.partitionBy("rec", "bin").orderBy("v")) - F.col("c"))
    found = each.groupBy("rec").agg(F.max(F.when(holds("first"), F.col("v"))).alias("a"), F.max(F.when(holds("second"), F.col("v"))).alias("b"))
    return found.select("rec", (F.col("a") * 0.5 + F.col("b") * 0.5).alias("median"))


def median_deviation(samples: DataFrame, channel: str, bins: int = BINS) -> DataFrame:
    """(rec, median, mad): the median and the unscaled median absolute deviation; nulls without a value."""
    median = medians(samples.select("rec", F.col(channel).alias("v")), bins)
    apart = samples.join(median, "rec").select("rec", F.abs(F.col(channel) - F.col("median")).alias("v"))
    rows = samples.select("rec").distinct().join(median, "rec", "left")
    return rows.join(medians(apart, bins).withColumnRenamed("median", "mad"), "rec", "left")


def local_maxima(samples: DataFrame, channel: str, size: int = blocks.BLOCK) -> DataFrame:
    """(rec, idx, height): samples, or the middles of plateaus, higher than both neighbours; none beside a missing sample."""
    rows = blocks.runs(samples.select("rec", "idx", channel), channel, size=size).where("idx = _first")
    found = rows.where((F.col(channel) > F.col("_prev.v")) & (F.col(channel) > F.col("_next.v")))
    return found.select("rec", F.floor((F.col("idx") + F.col("_next.idx") - 1) / 2).cast("long").alias("idx"), F.col(channel).alias("height"))
