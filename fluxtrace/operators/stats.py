"""Statistics of a trace by behavioural state, bout, period, and around events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .guards import require_columns

# Behaviours that are marks and no states.
NO_STATES = ("Entry in arena", "Gate opens", "Tail suspension")


def after_warm_up(samples: DataFrame, seconds: float = 15.0, time: str = "time_s") -> DataFrame:
    """Samples later than the warm-up."""
    return samples.where(F.col(time) > seconds)


def first_mark(samples: DataFrame, mark: Column, name: str = "start") -> DataFrame:
    """(rec, name): the first sample with the mark; null if there is none."""
    return samples.groupBy("rec").agg(F.min(F.when(mark, F.col("idx"))).alias(name))


def state_means(samples: DataFrame, state: str, level: str, value: str, least_active: int = 2) -> DataFrame:
    """(rec, state, active, mean): the mean where the state is on, null if it is on in at most ``least_active`` samples."""
    out = samples.groupBy("rec", state).agg(F.sum(level).cast("long").alias("active"), F.avg(F.when(F.col(level) == 1, F.col(value))).alias("mean"))
    return out.withColumn("mean", F.when(F.col("active") > least_active, F.col("mean")))


def period_means(samples: DataFrame, mark: Column, idle: Column, value: str) -> DataFrame:
    """(rec, start, baseline, post_baseline, mean_idle): means up to and including the first mark,
    from it on outside all behaviours, and outside all behaviours in the whole trial.

    Without a mark the start is sample 0.
    """
    rows = samples.join(first_mark(samples, mark), "rec").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    mean = lambda when: F.avg(F.when(when, F.col(value)))
    return rows.groupBy("rec").agg(F.first("start").alias("start"), mean(F.col("idx") <= F.col("start")).alias("baseline"), mean((F.col("idx") >= F.col("start")) & idle).alias("post_baseline"), mean(idle).alias("mean_idle"))


#: Samples of the arrays that events are joined with.
ARRAY = 1024


def window_samples(events: DataFrame, samples: DataFrame, before: int, after: int, value: str, at: str = "idx", size: int = ARRAY) -> DataFrame:
    """Each event with the samples before .. after around it; adds rel_idx and value.

    Samples are packed into arrays of ``size`` numbers; an event is joined with the few arrays that its
    window touches, by recording and array number, and what lies outside is cut off before the
    rest is unpacked.  The join gets rows in proportion to events, not to their windows.
    """
    require_columns(events, ["rec", at])
    lo, hi = F.col(at) + before, F.col(at) + after
    held = require_columns(samples, ["rec", "idx", value]).where("rec is not null and idx is not null").groupBy(F.col("rec").alias("_rec"), blocks.block_of("idx", size).alias("_array"))
    held = held.agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("_idx"), F.col(value).alias("value")))).alias("_held"))
    touched = events.withColumn("_array", F.explode(F.sequence(blocks.block_of(lo, size), blocks.block_of(hi, size))))
    rows = touched.alias("e").join(held.alias("h"), (F.col("e.rec") == F.col("h._rec")) & (F.col("e._array") == F.col("h._array"))).drop("_rec", "_array")
    # Numbers rise by one at least from place to place, which bounds the places of lo and hi from both ends.
    n = F.size("_held")
    first = F.greatest(F.lit(1).cast("long"), n - (F.element_at("_held", -1)["_idx"] - lo))
    last = F.least(n.cast("long"), hi - F.element_at("_held", 1)["_idx"] + 1)
    part = F.slice("_held", first.cast("int"), F.greatest(F.lit(0).cast("long"), last - first + 1).cast("int"))
    rows = rows.withColumn("_s", F.explode(part)).where(F.col("_s._idx").between(lo, hi))
    return rows.select(*events.columns, (F.col("_s._idx") - F.col(at)).cast("int").alias("rel_idx"), F.col("_s.value").alias("value"))


def bout_stats(pairs: DataFrame, samples: DataFrame, value: str, around: int = 5, size: int = blocks.BLOCK) -> DataFrame:
    """(rec, bout, idx_on, idx_off, mean, max, delta): of onset .. offset, both included, and the
    mean around the offset less that around the onset, windows clipped to the recording.

    A bout that ends before it starts has nulls.  Numbers have no gaps.
    """
    keys = ["rec", "bout", "idx_on", "idx_off"]
    inside = blocks.within(samples.select("rec", "idx", value), pairs.select(*keys), "idx_on", "idx_off", size=size)
    inside = inside.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    nearby = F.avg(value).over(blocks.in_block().rowsBetween(-around, around))
    local = blocks.haloed(samples.select("rec", "idx", value), around, around, size).withColumn("local", nearby).where("_own").select("rec", "idx", "local")
    on = local.select("rec", F.col("idx").alias("idx_on"), F.col("local").alias("at_on"))
    off = local.select("rec", F.col("idx").alias("idx_off"), F.col("local").alias("at_off"))
    rows = pairs.join(inside, keys, "left").join(on, ["rec", "idx_on"], "left").join(off, ["rec", "idx_off"], "left")
    return rows.select(*keys, "mean", "max", F.when(F.col("idx_off") >= F.col("idx_on"), F.col("at_off") - F.col("at_on")).alias("delta"))


def mean_over_bouts(stats: DataFrame) -> DataFrame:
    """(rec, n_bouts, mean, max, delta): the means of the bouts' figures."""
    return stats.groupBy("rec").agg(F.count("*").alias("n_bouts"), F.avg("mean").alias("mean"), F.avg("max").alias("max"), F.avg("delta").alias("delta"))


def variance_periods(samples: DataFrame, mark: Column, value: str) -> DataFrame:
    """(rec, var_all, var_baseline, var_post): population variances, split at the first mark (sample 0 without one)."""
    rows = samples.join(first_mark(samples, mark), "rec").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    var = lambda when: F.var_pop(F.when(when, F.col(value)))
    return rows.groupBy("rec").agg(F.var_pop(value).alias("var_all"), var(F.col("idx") < F.col("start")).alias("var_baseline"), var(F.col("idx") >= F.col("start")).alias("var_post"))


def before_after(events: DataFrame, samples: DataFrame, width: int, value: str) -> DataFrame:
    """(rec, bout, mean_before, mean_after, max_before, max_after): ``width`` samples to either side, the event in both."""
    rows = window_samples(events, samples, -width, width, value)
    before, after = F.when(F.col("rel_idx") <= 0, F.col("value")), F.when(F.col("rel_idx") >= 0, F.col("value"))
    return rows.groupBy("rec", "bout").agg(F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"), F.max(before).alias("max_before"), F.max(after).alias("max_after"))


def last_event(rows: DataFrame) -> DataFrame:
    """Of each recording the row of its last event only."""
    top = Window.partitionBy("rec").orderBy(F.col("bout").desc())
    return rows.withColumn("_k", F.row_number().over(top)).where("_k = 1").drop("_k")


def before_during(events: DataFrame, samples: DataFrame, width: int, value: str) -> DataFrame:
    """(rec, mean_before, mean_during, max_before, max_during) of the first event: the half-open
    windows [e - width, e) and [e, e + width)."""
    first = events.groupBy("rec").agg(F.min("idx").alias("idx"))
    rows = window_samples(first, samples, -width, width - 1, value)
    before, during = F.when(F.col("rel_idx") < 0, F.col("value")), F.when(F.col("rel_idx") >= 0, F.col("value"))
    return rows.groupBy("rec").agg(F.avg(before).alias("mean_before"), F.avg(during).alias("mean_during"), F.max(before).alias("max_before"), F.max(during).alias("max_during"))


def exact_level_means(states: DataFrame, samples: DataFrame, value: str) -> DataFrame:
    """(rec, kind, odor, n, mean): the mean where an odor's summed level is exactly 1."""
    rows = states.where("level = 1").join(samples.select("rec", "idx", value), ["rec", "idx"])
    return rows.groupBy("rec", "kind", "odor").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def match_counts(edges: DataFrame) -> DataFrame:
    """(rec, n_on, n_off, matched): whether a recording has as many onsets as offsets."""
    on, off = F.sum((F.col("edge") == 1).cast("long")), F.sum((F.col("edge") == -1).cast("long"))
    return edges.groupBy("rec").agg(F.coalesce(on, F.lit(0)).alias("n_on"), F.coalesce(off, F.lit(0)).alias("n_off")).withColumn("matched", F.col("n_on") == F.col("n_off"))
