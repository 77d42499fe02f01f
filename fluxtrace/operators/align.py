"""Alignment of traces with scored behaviour and with intervals in seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .guards import require_columns
from .sampling import renumber


def present(samples: DataFrame, channel: str, size: int = blocks.BLOCK) -> DataFrame:
    """(rec, idx, channel): a channel without its missing samples, numbered anew."""
    return renumber(samples.where(F.col(channel).isNotNull()).select("rec", "idx", channel), size=size)


def align_behaviour(trace: DataFrame, channels: list[str], states: DataFrame, starts: DataFrame, times: DataFrame) -> DataFrame:
    """(rec, idx, t, channels, level): behaviour laid beside the trace by sample number.

    states: (rec, idx, level).  starts: (rec, start), the sample where scoring began; rows
    before it have level 0.  times: (rec, idx, t).  Each channel drops its missing samples
    first; the shortest of channels, times and shifted states cuts all.
    """
    require_columns(trace, ["rec", "idx", *channels])
    require_columns(states, ["rec", "idx", "level"])
    out = times.select("rec", "idx", "t")
    for c in channels:
        out = out.join(present(trace, c), ["rec", "idx"])
    shifted = states.join(starts, "rec").select("rec", (F.col("idx") + F.col("start")).alias("idx"), "level")
    out = out.join(starts, "rec").join(shifted, ["rec", "idx"], "left")
    out = out.where((F.col("idx") < F.col("start")) | F.col("level").isNotNull())
    return out.select("rec", "idx", "t", *channels, F.coalesce("level", F.lit(0)).alias("level"))


def interval_samples(samples: DataFrame, intervals: DataFrame, rate: float, size: int = blocks.BLOCK) -> DataFrame:
    """(rec, kind, odor, ordinal, idx): the samples of intervals (rec, kind, odor, ordinal, start_s, stop_s).

    Ends are rounded to samples, halves to even, clamped to the recording, and included;
    an interval of [0, 0], or one that ends where it starts, has none.
    """
    top = samples.groupBy("rec").agg((F.count("*") - 1).alias("top"))
    clamp = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.rint(F.col(c) * rate).cast("long"), F.col("top")))
    rows = intervals.where("not (start_s = 0 and stop_s = 0)").join(top, "rec").withColumn("i0", clamp("start_s")).withColumn("i1", clamp("stop_s")).where("i1 > i0")
    found = blocks.within(samples.select("rec", "idx"), rows.select("rec", "kind", "odor", "ordinal", "i0", "i1"), "i0", "i1", size=size)
    return found.select("rec", "kind", "odor", "ordinal", "idx").distinct()


def number_intervals(intervals: DataFrame, order: str) -> DataFrame:
    """Adds ordinal, from 0, by recording, kind and odor in the order of the sheet's rows."""
    w = Window.partitionBy("rec", "kind", "odor").orderBy(order)
    return intervals.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


def by_name(intervals: DataFrame, part: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows whose name, ``<kind> <odor> <ordinal>``, holds a part, or starts with a prefix, or both."""
    name = F.concat_ws(" ", "kind", "odor", "ordinal")
    rows = intervals if part is None else intervals.where(name.contains(part))
    return rows if prefix is None else rows.where(name.startswith(prefix))


def interval_events(covered: DataFrame, samples: DataFrame, event: str = "onset", size: int = blocks.BLOCK) -> DataFrame:
    """(rec, kind, odor, ordinal, idx, bout): where intervals' samples begin, or, for a withdrawal, the first sample after.

    covered: (rec, kind, odor, ordinal, idx).  Intervals that overlap or touch are one if their ordinal is
    the same, and apart otherwise.  One that begins with the recording has no onset, one that lasts
    to its end no withdrawal.  bout counts a recording's events from 1.
    """
    if event not in ("onset", "withdrawal"):
        raise ValueError("event must be 'onset' or 'withdrawal'")
    rows = blocks.Carried(covered, ("rec", "kind", "odor", "ordinal"), size)
    if event == "onset":
        rows = rows.lag("_beside", F.col("idx")).frame().where("(_beside is null or _beside < idx - 1) and idx > 0")
    else:
        rows = rows.next("_beside", F.col("idx"), after=True).frame().where("_beside is null or _beside > idx + 1").withColumn("idx", F.col("idx") + 1)
        rows = rows.join(samples.groupBy("rec").agg(F.max("idx").alias("_top")), "rec").where("idx <= _top").drop("_top")
    bout = F.row_number().over(Window.partitionBy("rec").orderBy("kind", "odor", "ordinal", "idx"))
    return rows.drop("_beside").select("rec", "kind", "odor", "ordinal", "idx", bout.alias("bout"))


def roll_up(states: DataFrame) -> DataFrame:
    """(rec, idx, kind, odor, level): levels of all ordinals of an odor added up."""
    return states.groupBy("rec", "idx", "kind", "odor").agg(F.sum("level").cast("long").alias("level"))
