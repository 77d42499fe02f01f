"""Segments between artifacts, and the relative change computed segment by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .dff import fit_terms


def segments(samples: DataFrame, artifacts: DataFrame, time: str = "time_s", seconds: float = 60.0) -> DataFrame:
    """(rec, k, begin, end): for each artifact (rec, k, start_s, stop_s) in the order of k, and
    for the end of the recording, the segment before it.

    end is the last sample before the artifact starts, begin the first after the one
    before it stopped (0 at first); samples strictly between belong to the segment.  The
    end of a recording counts as an artifact that starts at its number of samples, in
    seconds.  An artifact that starts before the first sample has no segment.  seconds: the time
    that a task looks at.
    """
    count = samples.groupBy("rec").agg(F.count("*").alias("n"), F.max("idx").alias("top"))
    bounds = artifacts.select("rec", "k", "start_s", "stop_s").unionByName(
        count.join(artifacts.groupBy("rec").agg(F.max("k").alias("k")), "rec", "left").select("rec", (F.coalesce("k", F.lit(0)) + 1).alias("k"), F.col("n").cast("double").alias("start_s"), F.lit(None).cast("double").alias("stop_s"))
    )
    # One pass over samples and bounds in the order of time: a sample at a bound's own time is neither before nor after it.
    marks = [
        samples.where(F.col(time).isNotNull()).select("rec", F.col(time).cast("double").alias("at"), F.lit(1).alias("rank"), "idx", F.lit(None).cast("long").alias("k")),
        bounds.where("start_s is not null").select("rec", F.col("start_s").alias("at"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("idx"), F.col("k").cast("long").alias("k")),
        bounds.where("stop_s is not null").select("rec", F.col("stop_s").alias("at"), F.lit(2).alias("rank"), F.lit(None).cast("long").alias("idx"), F.col("k").cast("long").alias("k")),
    ]
    rows = marks[0].unionByName(marks[1]).unionByName(marks[2])
    rows = blocks.Carried(rows, order=("at", "rank"), block=F.floor(F.col("at") / seconds)).highest("_before", F.col("idx")).lowest("_after", F.col("idx")).frame()
    found = rows.where("rank != 1").groupBy("rec", "k").agg(F.max(F.when(F.col("rank") == 0, F.col("_before"))).alias("end"), F.min(F.when(F.col("rank") == 2, F.col("_after"))).alias("after"))
    ends = bounds.select("rec", "k").distinct().join(found.withColumnRenamed("k", "_k"), ["rec"]).where("k = _k").drop("_k")
    ends = ends.withColumn("after", F.when(F.col("end").isNotNull(), F.col("after")))
    before = Window.partitionBy("rec").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("rec", "k", F.coalesce(F.last("after", ignorenulls=True).over(before), F.lit(0).cast("long")).alias("begin"), "end").where("end is not null")


def in_segments(samples: DataFrame, parts: DataFrame, size: int = blocks.BLOCK) -> DataFrame:
    """Adds k, the last segment that holds the sample; null outside all."""
    inner = parts.select("rec", "k", (F.col("begin") + 1).alias("_lo"), (F.col("end") - 1).alias("_hi"))
    held = blocks.within(samples.select("rec", "idx"), inner, "_lo", "_hi", size=size)
    return samples.join(held.groupBy("rec", "idx").agg(F.max("k").alias("k")), ["rec", "idx"], "left")


def remove_artifacts(samples: DataFrame, artifacts: DataFrame, channel: str, method: str = "mean", control: str | None = None) -> DataFrame:
    """Adds clean: the channel's relative change by the mean, or fit, of its segment; null in
    and at the borders of artifacts.  fit needs the control channel."""
    if method not in ("mean", "fit"):
        raise ValueError("method must be 'mean' or 'fit'")
    rows = in_segments(samples, segments(samples, artifacts))
    if method == "mean":
        clean = (F.col(channel) - F.col("_mean")) / F.nullif(F.col("_mean"), F.lit(0.0)) * 100
        return blocks.with_totals(rows, ("rec", "k"), _mean=F.avg(channel)).withColumn("clean", clean).drop("_mean")
    terms = fit_terms(rows.where("k is not null"), control, channel, ("rec", "k"))
    rows = rows.join(terms, ["rec", "k"], "left").withColumn("fit", F.col("slope") * F.col(control) + F.col("intercept"))
    return rows.withColumn("clean", (F.col(channel) - F.col("fit")) / F.nullif("fit", F.lit(0.0)) * 100).drop("slope", "intercept")


def dff_or_default(samples: DataFrame, artifacts: DataFrame, channel: str) -> DataFrame:
    """Adds clean: by segments where a recording has artifacts, else by the whole recording's mean."""
    have = artifacts.select("rec").distinct().withColumn("listed", F.lit(True))
    rows = samples.join(have, "rec", "left")
    plain = blocks.with_totals(rows.where("listed is null"), ("rec",), _mean=F.avg(channel))
    plain = plain.withColumn("clean", (F.col(channel) - F.col("_mean")) / F.nullif(F.col("_mean"), F.lit(0.0)) * 100).drop("_mean")
    cut = remove_artifacts(rows.where("listed"), artifacts, channel)
    return plain.drop("listed").unionByName(cut.drop("listed", "k"))
