"""Bounded samples that are the same whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_by_hash(frame: DataFrame, key: str, most: int, hashed: bool = False) -> DataFrame:
    """At most ``most`` rows, those of least hash of key; hashed: the key is itself a 64-bit hash.

    Keys should not repeat.  The rows are counted first, and a threshold on the hash leaves about
    twice as many as are wanted, so that partitions send these and not ``most`` rows each.
    """
    value = F.col(key) if hashed else F.xxhash64(key)
    n = frame.count()
    if n > 4 * most + 1000:
        share = (2 * most + 500) / n
        frame = frame.where(value < int((share - 0.5) * 2**64))
    return frame.orderBy(value, key).limit(most)
