"""Order-dependent columns of recordings that many tasks share.

A recording is cut into blocks of ``BLOCK`` sample numbers.  Windows run within a block; what a block
needs of those before and after it (the last value, the last known one, a running sum, where a run
began) is carried by a table of one row a block, the only one with windows over a whole
recording.  Samples are shuffled once, by recording and block, for the summary, the join and all
windows.  Rows with a null key or number belong to no recording and are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .guards import require_columns

#: Sample numbers of a block.
BLOCK = 4096

_PAST = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def block_of(idx: str | Column, size: int = BLOCK) -> Column:
    """The number of the block that holds a sample."""
    return F.floor((F.col(idx) if isinstance(idx, str) else idx) / F.lit(size)).cast("long")


def _dealt(samples: DataFrame, keys: tuple[str, ...], block: Column) -> DataFrame:
    """Samples with _block, shuffled by it; a plan that reads them twice reuses the shuffle."""
    if "_block" in samples.columns:
        return samples
    # These are the filters that joins on keys and block imply: with them in every branch, branches share one shuffle.
    there = reduce(Column.__and__, (F.col(c).isNotNull() for c in (*keys, "_block")))
    return samples.withColumn("_block", block).where(there).repartition(*keys, "_block")


def deal(samples: DataFrame, keys: tuple[str, ...] = ("rec",), size: int = BLOCK) -> DataFrame:
    """Samples with _block, which operators on the same keys keep: a chain of them shuffles no more.

    Between, numbers must stay as they are.
    """
    return _dealt(samples, keys, block_of("idx", size))


def _along(keys: tuple[str, ...], back: bool = False) -> WindowSpec:
    """The window of a recording's blocks."""
    return Window.partitionBy(*keys).orderBy(F.desc("_block") if back else F.asc("_block"))


def _within(keys: tuple[str, ...], back: bool = False, order: tuple[str, ...] = ("idx",)) -> WindowSpec:
    """The window of a block's samples."""
    return Window.partitionBy(*keys, "_block").orderBy(*(F.desc(c) if back else F.asc(c) for c in order))


class Carried:
    """Collects columns to be added to samples (keys, idx, ...) and adds them in one pass.

    order, block: the order of a recording's rows, and blocks that rise with it, if not those of idx.
    Frames that end at the current row are filled once, also backwards, so looking ahead is a
    window in descending order.
    """

    def __init__(self, samples: DataFrame, keys: tuple[str, ...] = ("rec",), size: int = BLOCK, order: tuple[str, ...] = ("idx",), block: Column | None = None) -> None:
        self.samples, self.keys, self.order = require_columns(samples, [*keys, *order]), keys, order
        self.block = block_of("idx", size) if block is None else block
        self.values: dict[str, Column] = {}
        self.summaries: list[Column] = []
        self.carries: list[Column] = []
        self.results: dict[str, Column] = {}

    def _rows(self, back: bool = False) -> WindowSpec:
        return _within(self.keys, back, self.order)

    def _add(self, name: str, value: Column, summary: Column, carry: Column, result: Column) -> Carried:
        self.values[f"_v_{name}"] = value
        self.summaries.append(summary.alias(f"_s_{name}"))
        self.carries.append(carry.alias(f"_c_{name}"))
        self.results[name] = result
        return self

    def lag(self, name: str, value: Column) -> Carried:
        """The value of the row before; null at a recording's first."""
        v, s, c = F.struct(F.col(f"_v_{name}").alias("v")), F.col(f"_s_{name}"), F.col(f"_c_{name}")
        return self._add(name, value, F.max_by(v, F.struct(*self.order)), F.lag(s).over(_along(self.keys)), F.coalesce(F.lag(v).over(self._rows()), c)["v"])

    def last(self, name: str, value: Column, before: bool = False) -> Carried:
        """The last value that isn't null, up to the row, or up to the one before it."""
        v, s, c = F.col(f"_v_{name}"), F.col(f"_s_{name}"), F.col(f"_c_{name}")
        known = F.when(v.isNotNull(), F.struct(*self.order, v.alias("v")))
        carry = F.last(s, ignorenulls=True).over(_along(self.keys).rowsBetween(*_BEFORE))
        local = F.last(known, ignorenulls=True).over(self._rows().rowsBetween(*(_BEFORE if before else _PAST)))
        return self._add(name, value, F.max(known), carry, F.coalesce(local, c)["v"])

    def next(self, name: str, value: Column, after: bool = False) -> Carried:
        """The first value that isn't null, from the row, or from the one after it."""
        v, s, c = F.col(f"_v_{name}"), F.col(f"_s_{name}"), F.col(f"_c_{name}")
        known = F.when(v.isNotNull(), F.struct(*self.order, v.alias("v")))
        carry = F.last(s, ignorenulls=True).over(_along(self.keys, True).rowsBetween(*_BEFORE))
        local = F.last(known, ignorenulls=True).over(self._rows(True).rowsBetween(*(_BEFORE if after else _PAST)))
        return self._add(name, value, F.min(known), carry, F.coalesce(local, c)["v"])

    def total(self, name: str, value: Column) -> Carried:
        """The sum of the values up to the row."""
        v, s, c = F.col(f"_v_{name}"), F.col(f"_s_{name}"), F.col(f"_c_{name}")
        carry = F.sum(s).over(_along(self.keys).rowsBetween(*_BEFORE))
        local = F.sum(v).over(self._rows().rowsBetween(*_PAST))
        return self._add(name, value, F.sum(v), carry, F.coalesce(local + F.coalesce(c, F.lit(0)), local, c))

    def highest(self, name: str, value: Column) -> Carried:
        """The greatest value up to the row."""
        v, s, c = F.col(f"_v_{name}"), F.col(f"_s_{name}"), F.col(f"_c_{name}")
        carry = F.max(s).over(_along(self.keys).rowsBetween(*_BEFORE))
        return self._add(name, value, F.max(v), carry, F.greatest(F.max(v).over(self._rows().rowsBetween(*_PAST)), c))

    def lowest(self, name: str, value: Column) -> Carried:
        """The least value from the row on."""
        v, s, c = F.col(f"_v_{name}"), F.col(f"_s_{name}"), F.col(f"_c_{name}")
        carry = F.min(s).over(_along(self.keys, True).rowsBetween(*_BEFORE))
        return self._add(name, value, F.min(v), carry, F.least(F.min(v).over(self._rows(True).rowsBetween(*_PAST)), c))

    def frame(self) -> DataFrame:
        """The samples with all columns that were asked for."""
        rows = _dealt(self.samples.withColumns(self.values), self.keys, self.block)
        blocks = rows.groupBy(*self.keys, "_block").agg(*self.summaries).select(*self.keys, "_block", *self.carries)
        rows = rows.join(blocks.hint("shuffle_hash"), [*self.keys, "_block"]).withColumns(self.results)
        return rows.select(*dict.fromkeys([*self.samples.columns, *self.results]))


def numbered(samples: DataFrame, name: str, keys: tuple[str, ...] = ("rec",), size: int = BLOCK) -> DataFrame:
    """Adds the rows' numbers from 1 in the order of idx."""
    return Carried(samples, keys, size).total(name, F.lit(1).cast("long")).frame()


def runs(samples: DataFrame, value: str, keys: tuple[str, ...] = ("rec",), size: int = BLOCK) -> DataFrame:
    """Adds of the run of equal values (nulls equal each other) that holds the sample: _first, its first
    number; _next, the first number and value v of the run after it, null for the last; and _prev, the
    value v of the sample before, null for a recording's first.
    """
    v = F.struct(F.col(value).alias("v"))
    at = F.struct("idx", F.col(value).alias("v"))
    rows = _dealt(require_columns(samples, [*keys, "idx", value]), keys, block_of("idx", size)).withColumn("_lag", F.lag(v).over(_within(keys)))
    rows = rows.withColumn("_starts", F.when(F.col("_lag").isNotNull(), ~F.col(value).eqNullSafe(F.col("_lag.v"))))
    blocks = rows.groupBy(*keys, "_block").agg(F.min(F.struct("idx", v.alias("v"))).alias("head"), F.max(F.struct("idx", v.alias("v"))).alias("tail"), F.min(F.when(F.col("_starts"), at)).alias("low"), F.max(F.when(F.col("_starts"), F.col("idx"))).alias("high"))
    blocks = blocks.withColumn("_c_prev", F.lag("tail.v").over(_along(keys)))
    blocks = blocks.withColumn("_opens", F.col("_c_prev").isNull() | ~F.col("head.v").eqNullSafe(F.col("_c_prev")))
    first = F.when(F.col("_opens"), F.struct(F.col("head.idx").alias("idx"), F.col("head.v.v").alias("v"))).otherwise(F.col("low"))
    start = F.coalesce("high", F.when(F.col("_opens"), F.col("head.idx")))
    blocks = blocks.select(*keys, "_block", "_c_prev", "_opens", F.last(start, ignorenulls=True).over(_along(keys).rowsBetween(*_BEFORE)).alias("_c_first"), F.last(first, ignorenulls=True).over(_along(keys, True).rowsBetween(*_BEFORE)).alias("_c_next"))
    rows = rows.join(blocks.hint("shuffle_hash"), [*keys, "_block"]).withColumn("_starts", F.coalesce("_starts", "_opens"))
    rows = rows.withColumn("_first", F.coalesce(F.last(F.when(F.col("_starts"), F.col("idx")), ignorenulls=True).over(_within(keys).rowsBetween(*_PAST)), "_c_first"))
    rows = rows.withColumn("_next", F.coalesce(F.last(F.when(F.col("_starts"), at), ignorenulls=True).over(_within(keys, True).rowsBetween(*_BEFORE)), "_c_next"))
    rows = rows.withColumn("_prev", F.coalesce("_lag", "_c_prev"))
    return rows.select(*samples.columns, "_first", "_next", "_prev")


def with_totals(samples: DataFrame, keys: tuple[str, ...], **totals: Column) -> DataFrame:
    """Samples with aggregates over their whole recording, joined by key.

    A window would hold the recording in one task.  Of the join's sides one has a row a key: Spark
    sends it to all tasks if it is small, and else splits a key with many samples.  Samples
    whose key is null get nulls.
    """
    return samples.join(samples.groupBy(*keys).agg(*(value.alias(name) for name, value in totals.items())), list(keys), "left")


def haloed(samples: DataFrame, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """Samples with _block and _own; those up to ``before`` numbers ahead of a block, or ``after`` beyond it,
    are repeated there with _own false.  Frames of rows within a block then see what they would in the
    recording, if its numbers have no gaps.
    """
    require_columns(samples, ["rec", "idx"])
    first, last = block_of(F.col("idx") - after, size), block_of(F.col("idx") + before, size)
    rows = samples.drop("_block").withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))
    return rows.withColumn("_own", F.col("_block") == block_of("idx", size)).repartition("rec", "_block")


def in_block() -> WindowSpec:
    """The window of a block of ``haloed`` samples."""
    return _within(("rec",))


def cut(intervals: DataFrame, first: str, last: str, size: int = BLOCK) -> DataFrame:
    """Intervals of sample numbers, both ends included, once for each _block that they touch; empty ones go."""
    rows = intervals.where(F.col(first) <= F.col(last))
    return rows.withColumn("_block", F.explode(F.sequence(block_of(first, size), block_of(last, size))))


def within(samples: DataFrame, intervals: DataFrame, first: str, last: str, keys: tuple[str, ...] = ("rec",), size: int = BLOCK) -> DataFrame:
    """Each sample (keys, idx, ...) with each interval (keys, first, last, ...) that holds it.

    An equi-join on keys and block; the intervals' ends are looked at in the join.
    """
    left, right = samples.withColumn("_block", block_of("idx", size)), cut(intervals, first, last, size)
    same = [F.col(f"s.{k}") == F.col(f"i.{k}") for k in (*keys, "_block")]
    joined = left.alias("s").join(right.alias("i"), [*same, F.col("s.idx").between(F.col(f"i.{first}"), F.col(f"i.{last}"))])
    return joined.select(*(f"s.{c}" for c in samples.columns), *(f"i.{c}" for c in intervals.columns if c not in keys))


def counted(sizes: DataFrame, count: str, name: str, size: int = BLOCK) -> DataFrame:
    """Each row once for each name of 0 .. count - 1, which blocks of rows give in tasks of their own."""
    blocks = sizes.where(F.col(count) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), block_of(F.col(count) - 1, size))))
    blocks = blocks.repartition(*(c for c in ("rec",) if c in sizes.columns), "_block")
    start = F.col("_block") * size
    return blocks.withColumn(name, F.explode(F.sequence(start, F.least(F.col(count), start + size) - 1))).drop("_block")
