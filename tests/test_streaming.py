import datetime as dt

import pytest

from fluxtrace.streaming.clicks import on_arrival, pair_clicks


def test_clicks_pair_across_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start, 5.0), (1, start + dt.timedelta(seconds=1), 2.0), (1, start + dt.timedelta(seconds=2), 7.0), (2, start, 1.0)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id long, ts timestamp, value double"

    def run():
        stream = pair_clicks(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.user_id, r.pair, r.start, r.stop) for r in spark.read.parquet(out).collect())

    spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
    assert run() == [(1, 0, 2.0, 5.0)]
    spark.createDataFrame([(1, start + dt.timedelta(seconds=9), 3.0)], schema).write.mode("append").parquet(source)
    assert run() == [(1, 0, 2.0, 5.0), (1, 1, 3.0, 7.0)]


def test_files_are_handled_once(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    for _ in range(2):
        spark.range(3).write.mode("append").parquet(folder)
        on_arrival(spark, folder, "id long", lambda frame, k: seen.append(frame.count()), str(tmp_path / "c")).awaitTermination()
    assert seen == [3, 3]


def test_state_ends_and_late_clicks_are_counted(spark, tmp_path):
    """Five files, a run for each: a click that waits too long is given up, its state goes, and restarts change nothing."""
    start = dt.datetime(2024, 1, 1)
    at = lambda minutes: start + dt.timedelta(minutes=minutes)
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "user_id long, ts timestamp, value double"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = pair_clicks(spark.readStream.schema(schema).parquet(source), late="5 minutes", expiry_s=1800)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        operators = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        return sorted((r.user_id, r.pair, r.start, r.stop) for r in spark.read.parquet(out).collect()), operators[-1]["numRowsTotal"], sum(o["numRowsDroppedByWatermark"] for o in operators)

    assert run((1, at(0), 5.0), (2, at(0), 1.0), (2, at(1), 3.0)) == ([(2, 0, 1.0, 3.0)], 2, 0)
    found, states, dropped = run((3, at(120), 7.0))
    assert (found, states, dropped) == ([(2, 0, 1.0, 3.0)], 1, 0)  # keys 1 and 2 have left
    found, states, dropped = run((1, at(1), 6.0), (1, at(121), 9.0))
    assert (found, states, dropped) == ([(2, 0, 1.0, 3.0)], 2, 1)  # one came too late, the other begins anew
    assert run((1, at(122), 4.0))[0] == [(1, 0, 4.0, 9.0), (2, 0, 1.0, 3.0)]
    # In one batch as over several: an hour's gap gives up the click that waits.
    assert run((4, at(123), 1.0), (4, at(200), 2.0), (4, at(201), 3.0))[0] == [(1, 0, 4.0, 9.0), (2, 0, 1.0, 3.0), (4, 0, 2.0, 3.0)]
    with pytest.raises(ValueError):
        pair_clicks(spark.readStream.schema(schema).parquet(source), expiry_s=0)
