"""Operators in blocks of a few samples give what windows over whole recordings give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxtrace.operators import align, artifacts, blocks, dff, edges, fill, kernels, runs, sampling, smooth, stats

SIZES = [1, 7, 100, 4096]
SCHEMA = "rec long, idx long, time_s double, x double, level int"


@pytest.fixture(scope="module")
def samples(spark):
    rng, rows = random.Random(5), []
    for rec, n in ((0, 450), (1, 100), (2, 1), (3, 301)):
        level, x = 0, 0.0
        for i in range(n):
            level = 1 - level if rng.random() < 0.15 else level
            x = rng.choice([x, x, x + rng.choice([-1.0, 1.0, 2.5])])
            rows.append((rec, i, i / 10, None if rng.random() < 0.2 and rec != 1 else x, level))
    rows += [(4, i, i / 10, None, 0) for i in range(250)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def same(ours, theirs):
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    key = lambda frame: sorted(map(repr, frame.select(*columns).collect()))
    assert key(ours) == key(theirs)


@pytest.fixture(scope="module", autouse=True)
def windows(spark):
    """Windows over whole recordings; they need a session."""
    global WHOLE, PAST, BEFORE, AHEAD, AFTER
    WHOLE = Window.partitionBy("rec").orderBy("idx")
    PAST, BEFORE = WHOLE.rowsBetween(Window.unboundedPreceding, 0), WHOLE.rowsBetween(Window.unboundedPreceding, -1)
    AHEAD, AFTER = WHOLE.rowsBetween(0, Window.unboundedFollowing), WHOLE.rowsBetween(1, Window.unboundedFollowing)


@pytest.mark.parametrize("size", SIZES)
def test_carried_columns(samples, size):
    x, some = F.col("x"), samples.where("idx % 150 < 40")  # blocks without samples between
    for rows in (samples, some):
        ours = blocks.Carried(rows, size=size).lag("a", x).last("b", x).last("c", x, before=True).next("d", x).next("e", x, after=True).total("f", F.lit(1)).total("g", F.col("level")).highest("h", x).lowest("i", x).frame()
        theirs = rows.select(
            "*", F.lag("x").over(WHOLE).alias("a"), F.last("x", True).over(PAST).alias("b"), F.last("x", True).over(BEFORE).alias("c"), F.first("x", True).over(AHEAD).alias("d"), F.first("x", True).over(AFTER).alias("e"),
            F.count("*").over(PAST).alias("f"), F.sum("level").over(PAST).alias("g"), F.max("x").over(PAST).alias("h"), F.min("x").over(AHEAD).alias("i"),
        )
        same(ours, theirs)


@pytest.mark.parametrize("size", SIZES)
def test_edges_and_runs(samples, size):
    change = F.coalesce((F.col("level") != F.lag("level").over(WHOLE)).cast("int"), F.lit(0))
    run = samples.withColumn("_run", F.sum(change).over(PAST))
    run = run.withColumn("_n", F.count("*").over(Window.partitionBy("rec", "_run"))).withColumn("_last", F.max("_run").over(Window.partitionBy("rec")))
    for target, least in ((0, 1), (0, 2), (1, 2)):
        flips = (F.col("level") == target) & F.col("_n").between(least, 4) & (F.col("_run") < F.col("_last"))
        same(runs.flip_runs(samples, target, 4, least, size=size), run.withColumn("level", F.when(flips, 1 - target).otherwise(F.col("level"))).drop("_run", "_n", "_last"))
    derived = samples.withColumn("edge", F.col("level") - F.lag("level").over(WHOLE))
    same(edges.derive(samples, size=size), derived)
    numbers = lambda sign, name: derived.where(F.col("edge") == sign).select("rec", F.row_number().over(WHOLE).cast("long").alias("bout"), F.col("idx").alias(name))
    same(edges.bouts(derived, size=size), numbers(1, "idx_on").join(numbers(-1, "idx_off"), ["rec", "bout"]))
    strict = derived.withColumn("idx_off", F.first(F.when(F.col("edge") == -1, F.col("idx")), True).over(AFTER)).where("edge = 1 and idx_off is not null")
    same(edges.bouts(derived, strict=True, size=size), strict.select("rec", F.row_number().over(WHOLE).cast("long").alias("bout"), F.col("idx").alias("idx_on"), "idx_off"))


@pytest.mark.parametrize("size", [3, 100, 4096])
def test_highlights(samples, size):
    derived = edges.derive(samples)
    onset = F.last(F.when((F.col("edge") == 1) & (F.col("time_s") != 0), F.col("time_s")), True).over(PAST)
    previous = F.last(F.when(F.col("edge") == -1, F.col("time_s")), True).over(BEFORE)
    found = derived.withColumn("t_on", onset).withColumn("before", previous).where("edge = -1 and t_on is not null and (before is null or before < t_on)")
    same(edges.highlight_intervals(derived, size=size), found.select("rec", "t_on", F.col("time_s").alias("t_off")))


@pytest.mark.parametrize("size", SIZES)
def test_gaps_are_filled_over_blocks(samples, size):
    known = F.when(F.col("x").isNotNull(), F.struct("idx", "x"))
    a, b = F.last(known, True).over(PAST), F.first(known, True).over(AHEAD)
    rows = samples.withColumn("a", a).withColumn("b", b)
    share = (F.col("idx") - F.col("a.idx")) / F.nullif(F.col("b.idx") - F.col("a.idx"), F.lit(0))
    same(fill.interpolate(samples, "x", "y", size), rows.withColumn("y", F.coalesce("x", F.col("a.x") + (F.col("b.x") - F.col("a.x")) * share, "a.x", "b.x")).drop("a", "b"))


@pytest.mark.parametrize("size", [1, 7, 100, 4096])
def test_frames_reach_into_the_next_blocks(samples, size):
    theirs = samples.withColumn("y", F.avg("x").over(WHOLE.rowsBetween(-12, 0)))
    same(smooth.moving_average(samples, "x", 13, "y", size), theirs)
    filled = samples.where("rec < 2").withColumn("x", F.coalesce("x", F.lit(0.0)))
    same(smooth.hampel(filled, "x", "y", 5, 1.0, size=size), smooth.hampel(filled, "x", "y", 5, 1.0, size=10**9))


def maxima(values):
    """The middles of stretches of one value that are higher than what is beside them; None is no number."""
    found, i = [], 0
    while i < len(values):
        j = i
        while j + 1 < len(values) and values[j + 1] == values[i]:
            j += 1
        beside = [values[k] for k in (i - 1, j + 1) if 0 <= k < len(values)]
        if values[i] is not None and len(beside) == 2 and None not in beside and max(beside) < values[i]:
            found.append(((i + j) // 2, values[i]))
        i = j + 1
    return found


@pytest.mark.parametrize("size", SIZES)
def test_maxima_over_blocks(samples, size):
    theirs = set()
    for rec in range(5):
        values = [r.x for r in samples.where(F.col("rec") == rec).orderBy("idx").collect()]
        theirs |= {(rec, *m) for m in maxima(values)}
    assert {tuple(r) for r in smooth.local_maxima(samples, "x", size).collect()} == theirs and len(theirs) > 20


@pytest.mark.parametrize("size", SIZES)
def test_numbers_grids_and_intervals(spark, samples, size):
    same(sampling.crop(samples, 33, size), samples.where("idx >= 33").withColumn("idx", F.row_number().over(WHOLE).cast("long") - 1))
    same(align.present(samples, "x", size), samples.where("x is not null").select("rec", (F.row_number().over(WHOLE) - 1).cast("long").alias("idx"), "x"))
    sizes = spark.createDataFrame([(0, 0), (1, 1), (2, 4097), (3, 300)], "rec long, n long")
    assert sorted(map(tuple, blocks.counted(sizes, "n", "i", size).select("rec", "i").collect())) == [(r, i) for r, n in ((1, 1), (2, 4097), (3, 300)) for i in range(n)]
    spans = spark.createDataFrame([(0, "a", 5, 5), (0, "b", 0, 449), (0, "c", 95, 300), (1, "d", 99, 5000), (1, "e", 9, 8), (9, "f", 0, 9)], "rec long, name string, lo long, hi long")
    found = blocks.within(samples, spans, "lo", "hi", size=size).select("rec", "idx", "name")
    same(found, samples.join(spans, "rec").where("idx between lo and hi").select("rec", "idx", "name"))


@pytest.mark.parametrize("size", [7, 4096])
def test_bouts_segments_and_deinterleaving(spark, samples, size):
    whole = samples.where("rec in (0, 1, 3)").withColumn("x", F.coalesce("x", F.lit(1.5)))
    pairs = edges.bouts(edges.derive(whole))
    theirs = pairs.where("idx_off >= idx_on").join(whole, "rec").where("idx between idx_on and idx_off").groupBy("rec", "bout").agg(F.round(F.avg("x"), 9).alias("mean"), F.max("x").alias("max"))
    same(stats.bout_stats(pairs, whole, "x", size=size).select("rec", "bout", F.round("mean", 9).alias("mean"), "max").where("mean is not null"), theirs)
    stops = spark.createDataFrame([(0, 1, 3.05, 5.0), (0, 2, 20.0, 21.5), (3, 1, 0.0, 1.0)], "rec long, k int, start_s double, stop_s double")
    parts = artifacts.segments(whole, stops, seconds=1e9)
    for seconds in (0.3, 2.0, 60.0):
        same(artifacts.segments(whole, stops, seconds=seconds), parts)
    inside = whole.join(parts, "rec").where("idx > begin and idx < end").groupBy("rec", "idx").agg(F.max("k").alias("k"))
    same(artifacts.in_segments(whole, parts, size), whole.join(inside, ["rec", "idx"], "left"))
    gates = {"a": "level", "b": "other"}
    raw = whole.withColumn("other", 1 - F.col("level"))
    same(edges.deinterleave(raw, gates, "x", "time_s", 13, size), edges.deinterleave(raw, gates, "x", "time_s", 13, 10**9))


def test_rows_without_a_recording_or_number_are_left_out(spark):
    rows = spark.createDataFrame([(None, 0, 0.0, 1.0, 1), (1, None, 0.0, 1.0, 1), (1, 0, 0.0, 1.0, 1)], SCHEMA)
    assert [tuple(r) for r in edges.derive(rows).select("rec", "idx", "edge").collect()] == [(1, 0, None)]
    assert edges.derive(rows.limit(0)).count() == 0 == runs.fuse(rows.limit(0), 1, 10).count()


@pytest.mark.parametrize("size", [1, 7, 100, 1024])
def test_windows_around_events_come_from_arrays(spark, samples, size):
    events = spark.createDataFrame([(0, 1, 0), (0, 2, 3), (0, 3, 99), (0, 3, 99), (0, 4, 449), (1, 1, 60), (2, 1, 0), (3, 1, 5000), (9, 1, 1), (None, 1, 1), (1, 2, None)], "rec long, bout long, idx long")
    gaps = samples.where("idx % 13 != 5 and idx % 100 < 80")
    for rows in (samples, gaps):
        for before, after in ((-20, 30), (0, 0), (5, 9), (-500, 500)):
            e, s = events.alias("e"), rows.alias("s")
            inside = (F.col("e.rec") == F.col("s.rec")) & (F.col("s.idx") - F.col("e.idx")).between(before, after)
            theirs = e.join(s, inside).select("e.rec", "bout", "e.idx", (F.col("s.idx") - F.col("e.idx")).cast("int").alias("rel_idx"), F.col("x").alias("value"))
            same(stats.window_samples(events, rows, before, after, "x", size=size), theirs)


def test_events_are_joined_in_proportion_to_their_number(spark):
    samples = spark.range(20_000).select(F.lit(0).cast("long").alias("rec"), F.col("id").alias("idx"), F.col("id").cast("double").alias("x"))
    events = spark.range(5).select(F.lit(0).cast("long").alias("rec"), F.col("id").alias("bout"), (F.col("id") * 3000 + 3000).alias("idx"))
    out = stats.window_samples(events, samples, -300, 3000, "x")
    assert out.count() == 5 * 3301
    text = out._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("Join") :]
    assert below.count("Generate") == 1 and "sequence(" in below  # the events' arrays; windows are unpacked above the join


@pytest.mark.parametrize("bins", [1, 3, 1 << 16])
def test_medians_are_exact(spark, samples, bins):
    rng = random.Random(8)
    rows = [(r, v) for r, n in ((0, 1), (1, 2), (2, 99), (3, 100)) for v in [rng.choice([0.1, 0.2, 7.0, -3.25]) for _ in range(n)]]
    rows += [(4, 5.0)] * 7 + [(5, 1e308), (5, -1e308), (5, 0.25), (5, float("inf")), (6, None)] + [(7, 1e30)] + [(7, i / 1000) for i in range(500)]
    values = spark.createDataFrame(rows, "rec long, v double").repartition(4)
    assert sorted(map(tuple, smooth.medians(values, bins).collect())) == sorted(map(tuple, values.groupBy("rec").agg(F.median("v").alias("m")).where("m is not null").collect()))
    whole = samples.join(samples.groupBy("rec").agg(F.median("x").alias("median")), "rec").groupBy("rec").agg(F.first("median").alias("median"), F.median(F.abs(F.col("x") - F.col("median"))).alias("mad"))
    same(smooth.median_deviation(samples, "x", bins), whole)


def test_totals_of_recordings(spark, samples):
    rec = Window.partitionBy("rec")
    some = samples.where("rec < 4 and rec <> 2")
    rounded = lambda frame, *names: frame.withColumns({n: F.round(n, 8) for n in names})
    same(rounded(dff.dff_mean(some, "x", "idx"), "x_dff", "idx_dff"), rounded(some.withColumns({f"{c}_dff": (F.col(c) - F.avg(c).over(rec)) / F.nullif(F.avg(c).over(rec), F.lit(0.0)) * 100 for c in ("x", "idx")}), "x_dff", "idx_dff"))
    same(rounded(fill.mean_pad(some, "x", "y"), "y"), rounded(some.withColumn("y", F.coalesce("x", F.avg("x").over(rec))), "y"))
    line = F.regr_slope("x", "idx").over(rec) * F.col("idx") + F.regr_intercept("x", "idx").over(rec)
    same(rounded(smooth.detrend(some, "x", "y"), "y"), rounded(some.withColumn("y", F.col("x") - line), "y"))


def test_operators_say_which_column_is_missing(samples):
    calls = (lambda f: edges.derive(f.drop("idx")), lambda f: runs.fuse(f.drop("level"), 1, 10), lambda f: smooth.moving_average(f.drop("rec"), "x", 3, "y"), lambda f: stats.window_samples(f, f, -1, 1, "nothing"), lambda f: kernels.low_pass(f.drop("time_s"), "x"), lambda f: kernels.band_pass(f.drop("idx"), "x", 0.1, 1.0, 10.0))
    for call in calls:
        with pytest.raises(ValueError, match="no column"):
            call(samples)
