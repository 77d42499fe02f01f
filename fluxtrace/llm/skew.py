"""Joins and groups in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot beyond this many rows and this part of all rows, so there are at most ``SHARE`` hot
#: keys, a table that may be broadcast; and the parts that a hot key's rows are split into.
LEAST, SHARE, SALTS = 20_000, 100_000, 256


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame | None:
    """(key, hot): the keys with so many rows, marked for a broadcast; None if there are none."""
    hot = counts.where(F.col(n) > max(LEAST, total // SHARE))
    return None if hot.isEmpty() else F.broadcast(hot.select(key, F.lit(True).alias("hot")))


def marked(rows: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Rows with hot: whether their key is."""
    if hot is None:
        return rows.withColumn("hot", F.lit(False))
    return rows.join(hot, key, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def flagged(rows: DataFrame, key: str, hot: DataFrame | None, spread: str) -> DataFrame:
    """Rows with hot, and salt: the hash of spread in parts for a hot key, 0 for others."""
    part = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    return marked(rows, key, hot).withColumn("salt", F.lit(0) if hot is None else F.when(F.col("hot"), part).otherwise(0))


def repeated(rows: DataFrame) -> DataFrame:
    """Rows of one for each key, with hot, once for each salt of that key."""
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("salt", F.explode(salts)).drop("hot")


def joined(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame | None, spread: str) -> DataFrame:
    """Inner join of rows with side, which has each key once; the rows of a hot key are spread over tasks."""
    if hot is None:
        return rows.join(side.hint("shuffle_hash"), key)
    return flagged(rows, key, hot, spread).drop("hot").join(repeated(marked(side, key, hot)).hint("shuffle_hash"), [key, "salt"]).drop("salt")
