"""Edges, bouts and intervals of 0/1 states, deinterleaving, and click pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def derive(states: DataFrame, level: str = "level", keys: tuple[str, ...] = ("rec",), size: int = blocks.BLOCK) -> DataFrame:
    """Adds edge: the level's first difference; null for the first sample."""
    return blocks.Carried(states, keys, size).lag("_before", F.col(level)).frame().withColumn("edge", F.col(level) - F.col("_before")).drop("_before")


def derive_filled(states: DataFrame, level: str = "level", keys: tuple[str, ...] = ("rec",), size: int = blocks.BLOCK) -> DataFrame:
    """As ``derive``, with 0 for a difference that is missing."""
    return derive(states, level, keys, size).withColumn("edge", F.coalesce("edge", F.lit(0)))


def bouts(edges: DataFrame, keys: tuple[str, ...] = ("rec",), strict: bool = False, size: int = blocks.BLOCK) -> DataFrame:
    """(keys, bout, idx_on, idx_off): the k-th onset with the k-th offset.

    strict pairs each onset with the next offset after it instead, which differs where a
    state is on at the first sample.
    """
    if strict:
        marked = blocks.Carried(edges.where("edge <> 0").select(*keys, "idx", "edge"), keys, size)
        found = marked.next("idx_off", F.when(F.col("edge") == -1, F.col("idx")), after=True).frame().where("edge = 1 and idx_off is not null")
        return blocks.numbered(found, "bout", keys, size).select(*keys, "bout", F.col("idx").alias("idx_on"), "idx_off")
    on, off = F.col("edge") == 1, F.col("edge") == -1
    marked = blocks.Carried(edges.where(on | off).select(*keys, "idx", "edge"), keys, size).total("_on", on.cast("long")).total("_off", off.cast("long")).frame()
    pairs = marked.groupBy(*keys, F.when(on, F.col("_on")).otherwise(F.col("_off")).alias("bout")).agg(F.max(F.when(on, F.col("idx"))).alias("idx_on"), F.max(F.when(off, F.col("idx"))).alias("idx_off"))
    return pairs.where("idx_on is not null and idx_off is not null")


def long_enough(pairs: DataFrame, least_s: float, rate: float) -> DataFrame:
    """Bouts of more than one sample that last ``least_s`` seconds at least."""
    duration = F.col("idx_off") - F.col("idx_on")
    return pairs.where((duration > 1) & (duration >= least_s * rate))


def highlight_intervals(edges: DataFrame, time: str = "time_s", keys: tuple[str, ...] = ("rec",), size: int = blocks.BLOCK) -> DataFrame:
    """(keys, t_on, t_off): for each offset the last onset before it; an onset at time 0 doesn't count."""
    rows = blocks.Carried(edges.where("edge <> 0").select(*keys, "idx", "edge", time), keys, size)
    rows = rows.last("t_on", F.when((F.col("edge") == 1) & (F.col(time) != 0), F.col(time))).last("before", F.when(F.col("edge") == -1, F.col(time)), before=True)
    found = rows.frame().where("edge = -1 and t_on is not null and (before is null or before < t_on)")
    return found.select(*keys, "t_on", F.col(time).alias("t_off"))


def click_pairs(clicks: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, pair, start, stop): clicks taken two by two, the lesser first; an odd last click waits."""
    numbered = clicks.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    pairs = numbered.groupBy(key, F.floor((F.col("k") - 1) / 2).cast("long").alias("pair"))
    return pairs.agg(F.min(value).alias("start"), F.max(value).alias("stop"), F.count("*").alias("n")).where("n = 2").drop("n")


def deinterleave(raw: DataFrame, gates: dict[str, str], signal: str, time: str, offset: int = 250, size: int = blocks.BLOCK) -> DataFrame:
    """(rec, idx, time_s, one column for each gate): the signal ``offset`` samples after each rising edge.

    gates: output column to gate column.  The k-th samples of all gates make row k - 1, as
    far as the gate with the fewest; edges whose sample lies beyond the recording don't count, a
    missing sample does.  Numbers have no gaps.  Times run evenly from 0 to the last raw time, and zeros become null in
    every column.
    """
    gated = blocks.Carried(raw.select("rec", "idx", *gates.values()), size=size)
    for name, gate in gates.items():
        gated.lag(f"_before_{name}", F.col(gate))
    rose = {name: F.coalesce((F.col(gate) - F.col(f"_before_{name}") == 1).cast("long"), F.lit(0).cast("long")) for name, gate in gates.items()}
    rises = gated.frame().select("rec", "idx", *(rise.alias(f"_rose_{name}") for name, rise in rose.items())).where(" or ".join(f"_rose_{name} = 1" for name in gates))
    later = raw.select("rec", (F.col("idx") - offset).alias("idx"), F.col(signal).alias("_v"))
    marked = blocks.Carried(rises.join(later, ["rec", "idx"]), size=size)
    for name in gates:
        marked.total(f"_k_{name}", F.col(f"_rose_{name}"))
    each = F.explode(F.filter(F.array(*(F.struct(F.lit(name).alias("gate"), F.col(f"_rose_{name}").alias("rose"), F.col(f"_k_{name}").alias("k")) for name in gates)), lambda x: x.rose == 1))
    rows = marked.frame().select("rec", "_v", each.alias("_of")).groupBy("rec", F.col("_of.k").alias("k"))
    found = rows.agg(F.count("*").alias("_gates"), *(F.max(F.when(F.col("_of.gate") == name, F.col("_v"))).alias(name) for name in gates)).where(F.col("_gates") == len(gates))
    whole = found.groupBy("rec").agg(F.count("*").alias("_n")).join(raw.groupBy("rec").agg(F.max(time).alias("_last")), "rec")
    t = (F.col("k") - 1) * F.col("_last") / F.nullif(F.col("_n") - 1, F.lit(0))
    rows = found.join(whole, "rec").withColumn("time_s", F.coalesce(t, F.lit(0.0)))
    zero = lambda c: F.nullif(F.col(c), F.lit(0.0)).alias(c)
    return rows.select("rec", (F.col("k") - 1).alias("idx"), zero("time_s"), *map(zero, gates))
