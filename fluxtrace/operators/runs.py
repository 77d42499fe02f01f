"""Run editing of 0/1 states: gaps are filled, short bouts cleared, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Shortest run that is edited: scored behaviour leaves single samples alone, respiration doesn't.
BEHAVIOUR, SNIFFS = 2, 1


def flip_runs(states: DataFrame, target: int, most: float, least: int, keys: tuple[str, ...] = ("rec",), level: str = "level", size: int = blocks.BLOCK) -> DataFrame:
    """Flips the runs of ``target`` of least .. most samples that another run follows."""
    rows = blocks.runs(states, level, keys, size)
    flips = (F.col(level) == target) & (F.col("_next.idx") - F.col("_first")).between(least, most)
    return rows.withColumn(level, F.when(flips, F.lit(1 - target)).otherwise(F.col(level))).select(*states.columns)


def fuse(states: DataFrame, gap_s: float, rate: float, least: int = BEHAVIOUR, keys: tuple[str, ...] = ("rec",), size: int = blocks.BLOCK) -> DataFrame:
    """Fills gaps of up to ``gap_s`` seconds that a bout follows; a leading gap counts."""
    return flip_runs(states, 0, gap_s * rate, least, keys, size=size)


def prune(states: DataFrame, bout_s: float, rate: float, least: int = BEHAVIOUR, keys: tuple[str, ...] = ("rec",), size: int = blocks.BLOCK) -> DataFrame:
    """Clears bouts of up to ``bout_s`` seconds that a gap follows; a trailing bout stays."""
    return flip_runs(states, 1, bout_s * rate, least, keys, size=size)
