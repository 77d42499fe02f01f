"""Small inputs with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from fluxtrace.functions import scalars as S
from fluxtrace.operators import align, artifacts, dff, edges, fill, guards, peth, runs, sampling, smooth


def series(spark, values, name="level", kind="int"):
    return spark.createDataFrame([(0, i, i / 10, v) for i, v in enumerate(values)], f"rec long, idx long, time_s double, {name} {kind}")


def column(frame, name):
    return [r[name] for r in frame.orderBy("idx").collect()]


def bits(text):
    return [int(x) for x in text.split()]


@pytest.mark.parametrize(
    ("edit", "seconds", "least", "before", "after"),
    [
        (runs.fuse, 0.3, 2, "0 0 1 1 0 1 0 0 0 1 0 0", "1 1 1 1 0 1 1 1 1 1 0 0"),
        (runs.prune, 0.4, 2, "1 1 1 1 0 1 1 1 1 1 0 0", "0 0 0 0 0 1 1 1 1 1 0 0"),
        (runs.fuse, 0.3, 1, "0 0 1 1 0 1 0 0 0 1 0 0", "1 1 1 1 1 1 1 1 1 1 0 0"),
        (runs.prune, 0.2, 1, "1 0 1 1 0 1 1 1", "0 0 0 0 0 1 1 1"),
        (runs.prune, 0.2, 2, "1 0 1 1 0 1 1 1", "1 0 0 0 0 1 1 1"),
    ],
)
def test_run_editing(spark, edit, seconds, least, before, after):
    assert column(edit(series(spark, bits(before)), seconds, 10, least), "level") == bits(after)


def test_fusing_twice_changes_nothing(spark):
    once = runs.fuse(series(spark, bits("0 1 0 0 1 1 0 0 0 0 1 0 1")), 0.3, 10)
    assert column(runs.fuse(once, 0.3, 10), "level") == column(once, "level")


def test_differences(spark):
    s = series(spark, [0, 1, 1, 0])
    assert column(edges.derive(s), "edge") == [None, 1, 0, -1]
    assert column(edges.derive_filled(s), "edge") == [0, 1, 0, -1]


def test_interpolation(spark):
    s = series(spark, [None, 1.0, None, None, 4.0, None], "x", "double")
    assert column(fill.interpolate(s, "x", "y"), "y") == [1, 1, 2, 3, 4, 4]


def test_moving_average_and_deviation(spark):
    assert column(smooth.moving_average(series(spark, [1.0, 2.0, 3.0, 4.0], "x", "double"), "x", 3, "y"), "y") == [1, 1.5, 2, 3]
    row = smooth.median_deviation(series(spark, [1.0, 2.0, 4.0, 8.0], "x", "double"), "x").first()
    assert (row.median, row.mad) == (3, 1.5)


def test_rates_and_grids(spark):
    assert sampling.sample_rate(series(spark, [0, 0, 0])).first().samplerate == pytest.approx(15)
    four = sampling.resample_nearest(series(spark, [0, 1, 2, 3]), series(spark, [0, 0, 0]), "level")
    assert [r.idx for r in four.orderBy("j").collect()] == [0, 2, 3]
    five = sampling.resample_nearest(series(spark, [0, 1, 2, 3, 4]), series(spark, [0, 0, 0]), "level")
    assert [r.idx for r in five.orderBy("j").collect()] == [0, 2, 4]
    times = spark.createDataFrame([(0, 0, 1.0), (0, 1, 9.3), (0, 2, 9.4)], "rec long, idx long, time_s double")
    grid = sampling.time_vector(times, 10).orderBy("i").collect()
    assert len(grid) == 101 and grid[0].t == 0 and grid[-1].t == 10


def test_relative_change(spark):
    assert column(dff.dff_mean(series(spark, [1.0, 2.0, 3.0], "x", "double"), "x"), "x_dff") == [-50, 0, 50]
    rows = spark.createDataFrame([(0, i, float(i + 1), 2.0 * (i + 1)) for i in range(3)], "rec long, idx long, ctrl double, sig double")
    out = dff.dff_fit(rows)
    assert column(out, "fit") == pytest.approx([2, 4, 6]) and column(out, "denoised") == pytest.approx([0, 0, 0])


def test_segments(spark):
    rows = spark.createDataFrame([(0, i, float(i), 1.0 + i) for i in range(10)], "rec long, idx long, time_s double, x double")
    art = spark.createDataFrame([(0, 1, 3.5, 5.5)], "rec long, k int, start_s double, stop_s double")
    clean = column(artifacts.remove_artifacts(rows, art, "x"), "clean")
    assert [i for i, v in enumerate(clean) if v is not None] == [1, 2, 7, 8]
    with pytest.raises(ValueError):
        artifacts.remove_artifacts(rows, art, "x", "median")


def test_clicks(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, 2.0), (1, 2, 7.0)], "u long, t long, v double")
    assert [(r.start, r.stop) for r in edges.click_pairs(rows, "u", ["t"], "v").collect()] == [(2, 5)]


def test_duration(spark):
    pairs = spark.createDataFrame([(0, 1, 0, 1), (0, 2, 0, 5), (0, 3, 0, 4)], "rec long, bout long, idx_on long, idx_off long")
    assert {r.bout for r in edges.long_enough(pairs, 0.5, 10).collect()} == {2}
    assert {r.bout for r in edges.long_enough(pairs, 0, 10).collect()} == {2, 3}


def test_scalars(spark):
    rows = spark.createDataFrame([(12.39,), (-1.29,)], "x double").select(S.truncate(F.col("x"), 1).alias("y"))
    assert [r.y for r in rows.collect()] == [12.3, -1.2]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(S.half_even(F.col("x")).alias("y"))
    assert [r.y for r in halves.collect()] == [0, 2, 2]
    text = spark.createDataFrame([("[(1.5, 2), (3.0, 4.25)]",)], "t string").select(S.parse_intervals(F.col("t")).alias("p"))
    assert text.first().p == [[1.5, 2.0], [3.0, 4.25]]
    codes = spark.createDataFrame([("Test",), ("S3",), ("?",), (None,)], "s string").select(S.session_code(F.col("s")).alias("c"))
    assert [r.c for r in codes.collect()] == ["1", "2", "Unknown", "Unknown"]


def test_deinterleave(spark):
    n = 24
    rows = [(0, i, i / 10, float(i), int(i % 8 in (1, 2)), int(i % 8 in (5, 6))) for i in range(n)]
    raw = spark.createDataFrame(rows, "rec long, idx long, time_s double, ain double, a int, b int")
    out = edges.deinterleave(raw, {"c405": "a", "c470": "b"}, "ain", "time_s", 1).orderBy("idx").collect()
    assert [(r.c405, r.c470) for r in out] == [(2, 6), (10, 14), (18, 22)]
    assert [r.time_s for r in out] == [None, pytest.approx(1.15), pytest.approx(2.3)]


def test_deinterleave_keeps_the_place_of_missing_samples(spark):
    rows = [(0, i, i / 10, None if i == 10 else float(i), int(i % 8 in (1, 2)), int(i % 8 in (5, 6))) for i in range(24)]
    raw = spark.createDataFrame(rows, "rec long, idx long, time_s double, ain double, a int, b int")
    out = edges.deinterleave(raw, {"c405": "a", "c470": "b"}, "ain", "time_s", 1).orderBy("idx").collect()
    assert [(r.c405, r.c470) for r in out] == [(2, 6), (None, 14), (18, 22)]


def test_flat_traces_keep_their_values(spark):
    rows = series(spark, [4.0] * 9, "x", "double")
    events = spark.createDataFrame([(0, 1, 4)], "rec long, bout long, idx long")
    assert {r.z for r in peth.peth(events, rows, 2, 2, "x").collect()} == {None}
    assert {r.z for r in peth.peth(events, rows, 2, 2, "x", raw_if_flat=True).collect()} == {4.0}


def test_strict_bouts_pair_with_the_next_offset(spark):
    found = edges.bouts(edges.derive(series(spark, [1, 0, 1, 1, 0, 0, 1])), strict=True)
    assert [(r.bout, r.idx_on, r.idx_off) for r in found.collect()] == [(1, 2, 4)]


def test_empty_recordings(spark):
    empty = series(spark, [])
    for frame in (runs.fuse(empty, 0.3, 10), edges.derive(empty), edges.bouts(edges.derive(empty)), smooth.detrend(empty, "level", "y"), sampling.sample_rate(empty)):
        assert frame.count() == 0


def test_segments_at_the_very_times_of_artifacts(spark):
    s = series(spark, [1.0] * 10, "x", "double")
    listed = spark.createDataFrame([(0, 1, 0.2, 0.4), (0, 2, 0.7, 0.9)], "rec long, k int, start_s double, stop_s double")
    assert sorted((r.k, r.begin, r.end) for r in artifacts.segments(s, listed).collect()) == [(1, 0, 1), (2, 5, 6), (3, 5, 9)]


def test_interval_events(spark):
    rows = [(0, "Sniff", "Clean", 0, i) for i in (0, 1, 4, 5)] + [(0, "Sniff", "Clean", 1, i) for i in (5, 6, 9)]
    covered = spark.createDataFrame(rows, "rec long, kind string, odor string, ordinal long, idx long")
    s = series(spark, [0] * 10)
    at = lambda event: sorted((r.ordinal, r.idx) for r in align.interval_events(covered, s, event).collect())
    assert at("onset") == [(0, 4), (1, 5), (1, 9)]
    assert at("withdrawal") == [(0, 2), (0, 6), (1, 7)]
    with pytest.raises(ValueError):
        align.interval_events(covered, s, "middle")


def test_names(spark):
    rows = spark.createDataFrame([("Sniff", "HC", 1), ("Sniff", "HC", 10), ("Stim", "HC", 1)], "kind string, odor string, ordinal int")
    assert align.by_name(rows, part="HC 1").count() == 3 and align.by_name(rows, prefix="Sniff HC").count() == 2
    assert align.by_name(rows, part="10", prefix="Sniff").count() == 1


def test_guards(spark):
    s = series(spark, [0])
    assert guards.require_rows(guards.require_columns(s, ["level"])) is s
    for frame, columns, error in ((s, ["none"], ValueError), (s, "level", TypeError), ([], ["level"], TypeError)):
        with pytest.raises(error):
            guards.require_columns(frame, columns)
    with pytest.raises(ValueError):
        guards.require_rows(s.where("idx < 0"))
    with pytest.raises(ValueError):
        sampling.camera_start(s, 12.3, required=True)


def test_warm_up_of_nothing_and_of_forty_seconds(spark):
    from fluxtrace.operators import stats

    s = spark.createDataFrame([(0, i, 10.0 * i) for i in range(6)], "rec long, idx long, time_s double")
    assert [stats.after_warm_up(s, x).count() for x in (0.0, 40.0)] == [5, 1]


def test_interval_texts_both_ways(spark):
    pairs = spark.createDataFrame([([[1.5, 2.0], [3.0, 4.25]],)], "p array<array<double>>")
    text = pairs.select(S.format_intervals(F.col("p")).alias("t"))
    assert text.select(S.parse_intervals(F.col("t")).alias("p")).first().p == [[1.5, 2.0], [3.0, 4.25]]
