"""Event-triggered z-scores (PETH): long rows (rec, bout, rel_idx, z), their averages and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import window_samples


def first_events(events: DataFrame, most: int) -> DataFrame:
    """The first ``most`` events of each recording."""
    return events.where(F.col("bout") <= most)


def early_enough(events: DataFrame, samples: DataFrame, post: int) -> DataFrame:
    """Events with ``post`` samples after them."""
    sizes = samples.groupBy("rec").agg(F.count("*").alias("_n"))
    return events.join(sizes, "rec").where(F.col("idx") + post < F.col("_n")).drop("_n")


def shift_to_trough(events: DataFrame, samples: DataFrame, before: int, after: int, value: str) -> DataFrame:
    """Events moved to the least value in before .. after around them; the first of equals, nulls aside."""
    rows = window_samples(events, samples, before, after, value).where("value is not null")
    found = rows.groupBy("rec", "bout", "idx").agg(F.min(F.struct("value", "rel_idx"))["rel_idx"].alias("_by"))
    return events.join(found, ["rec", "bout", "idx"]).withColumn("idx", F.col("idx") + F.col("_by")).drop("_by")


def peth(events: DataFrame, samples: DataFrame, pre: int, post: int, value: str, baseline: tuple[int, int] | None = None, raw_if_flat: bool = False) -> DataFrame:
    """(rec, bout, idx, rel_idx, z) of samples pre before to post after each event (rec, bout, idx).

    z uses the mean and sample deviation of the whole trace, or, with a baseline
    (first, last) in samples relative to the event, both included, those of that window.
    Windows that the recording doesn't hold whole are left out.  Without a deviation above 0 z is null,
    or, if raw_if_flat (respiration), the value as it is.
    """
    first = min(-pre, baseline[0]) if baseline else -pre
    last = max(post, baseline[1]) if baseline else post
    rows = window_samples(events.select("rec", "bout", "idx"), samples, first, last, value)
    each = Window.partitionBy("rec", "bout", "idx")
    shown = F.col("rel_idx").between(-pre, post)
    rows = rows.withColumn("_n", F.sum(shown.cast("int")).over(each)).where(F.col("_n") == pre + post + 1)
    if baseline:
        inside = F.when(F.col("rel_idx").between(*baseline), F.col("value"))
        rows = rows.withColumn("_mean", F.avg(inside).over(each)).withColumn("_sd", F.stddev_samp(inside).over(each)).where(shown)
    else:
        whole = samples.groupBy("rec").agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
        rows = rows.join(whole, "rec")
    z = F.when(F.col("_sd") > 0, (F.col("value") - F.col("_mean")) / F.col("_sd"))
    if raw_if_flat:
        z = F.when(F.col("_sd") > 0, z).otherwise(F.col("value"))
    return rows.select("rec", "bout", "idx", "rel_idx", z.alias("z"))


def average(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, rel_idx, n, mean_z, sem_z); the standard error uses the population deviation."""
    return rows.groupBy(*keys, "rel_idx").agg(F.count("z").alias("n"), F.avg("z").alias("mean_z"), (F.stddev_pop("z") / F.sqrt(F.nullif(F.count("z"), F.lit(0)))).alias("sem_z"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, rel_idx, n, mean_z, sd_z): the mean over bouts and the population deviation around it."""
    return rows.groupBy(*keys, "rel_idx").agg(F.count("z").alias("n"), F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("sd_z"))


def pool(rows: DataFrame, groups: DataFrame, key: str = "grp") -> DataFrame:
    """(key, rel_idx, n, mean_z, sem_z): means of recordings' means by group."""
    each = rows.groupBy("rec", "rel_idx").agg(F.avg("z").alias("z"))
    return average(each.join(groups, "rec"), key)


def mean_max(rows: DataFrame) -> DataFrame:
    """(rec, bout, mean_before, mean_after, max_before, max_after) of z, split at the event."""
    before, after = F.when(F.col("rel_idx") < 0, F.col("z")), F.when(F.col("rel_idx") >= 0, F.col("z"))
    return rows.groupBy("rec", "bout").agg(F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"), F.max(before).alias("max_before"), F.max(after).alias("max_after"))


def wide(rows: DataFrame, bouts: list[int]) -> DataFrame:
    """(rec, rel_idx, bout_<k> ...): time by bouts, for the stated bouts."""
    out = rows.where(F.col("bout").isin(bouts)).groupBy("rec", "rel_idx").pivot("bout", bouts).agg(F.first("z"))
    return out.select("rec", "rel_idx", *(F.col(str(b)).alias(f"bout_{b}") for b in bouts))
