"""Clicks paired to intervals as they arrive, and recordings handled as their files arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pair_clicks(clicks: DataFrame, key: str = "user_id", order: str = "ts", value: str = "value", late: str = "10 minutes", expiry_s: float = 86_400.0) -> DataFrame:
    """A stream of (key, pair, start, stop): each key's clicks two by two, the lesser value first.

    Clicks of a batch are taken in the order of their times, equal ones as they come.  A click more than
    ``expiry_s`` seconds after its key's last one begins anew: the one that waits is given up, and
    pairs count from 0.  So a key's state (its pairs, the click that waits, the last time) has no
    effect after that, and an event-time timer removes it.  Clicks later than ``late`` behind the
    newest time of the stream are dropped; Spark's progress reports count them as
    numRowsDroppedByWatermark.
    """
    if expiry_s <= 0:
        raise ValueError("clicks must wait for some time")
    kind, expiry = clicks.schema[key].dataType.simpleString(), int(expiry_s * 1000)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            pairs, waits, pending, last = state.get if state.exists else (0, False, 0.0, None)
            rows = pd.concat(list(frames)).sort_values(order, kind="stable")
            for at, v in zip(rows[order].astype("datetime64[ms]").astype("int64").tolist(), rows[value].tolist(), strict=True):
                if last is not None and at - last > expiry:
                    pairs, waits = 0, False
                last = at if last is None else max(last, at)
                if waits:
                    out.append((group[0], pairs, min(pending, v), max(pending, v)))
                    pairs, waits = pairs + 1, False
                else:
                    pending, waits = float(v), True
            state.update((pairs, waits, pending, last))
            state.setTimeoutTimestamp(last + expiry + 1)
        yield pd.DataFrame(out, columns=[key, "pair", "start", "stop"])

    source = clicks.withWatermark(order, late).select(key, order, value)
    return source.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, pair long, start double, stop double", "pairs long, waits boolean, pending double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def on_arrival(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each Parquet file below a folder once to ``handle``, across restarts, then stops."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
