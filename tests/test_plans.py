"""Physical plans are the intended ones."""

from oracle import DATA
from pyspark.sql import functions as F

from fluxtrace.catalogue import QUERIES
from fluxtrace.operators import align, artifacts, blocks, edges, fill, runs, sampling, smooth, stats


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loops(spark):
    for name in ("q_peth_mean", "q_stim_columns", "q_before_after", "q_dff_artifacts", "q_align_zip"):
        assert "NestedLoop" not in plan(QUERIES[name](spark, DATA)), name


def test_columns_are_pruned(spark):
    text = plan(QUERIES["q_derive"](spark, DATA))
    assert "props" not in text


def sample_windows(text):
    """The window operators of a plan that aren't over blocks or their summaries."""
    return [x for x in text.splitlines() if "Window [" in x and "_block" not in x]


def test_a_chain_in_blocks_shuffles_its_samples_once(spark):
    samples = spark.range(20_000).select((F.col("id") % 3).alias("rec"), F.floor(F.col("id") / 3).alias("idx"), (F.col("id") % 7 < 3).cast("int").alias("level"))
    chain = runs.prune(runs.fuse(edges.derive(blocks.deal(samples, size=100)), 0.3, 10), 0.4, 10)
    chain.collect()
    text = plan(chain).split("== Initial Plan ==")[0]
    dealt = [x for x in text.splitlines() if "REPARTITION_BY_COL" in x and "ReusedExchange" not in x]
    # Once with all columns; and once without those that a branch doesn't need.
    assert len(dealt) <= 2 and "ReusedExchange" in text and not sample_windows(text)


def test_no_window_holds_a_recording(spark):
    samples = spark.range(1000).select((F.col("id") % 2).alias("rec"), F.floor(F.col("id") / 2).alias("idx"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5 < 2).cast("int").alias("level"))
    stops = spark.createDataFrame([(0, 1, 3.0, 5.0)], "rec long, k int, start_s double, stop_s double")
    timed = samples.withColumn("time_s", F.col("idx") / 10)
    for frame in (
        edges.derive(samples), edges.derive_filled(samples), runs.fuse(samples, 0.3, 10), runs.prune(samples, 0.3, 10), fill.interpolate(samples, "x", "y"), smooth.moving_average(samples, "x", 3, "y"), smooth.hampel(samples, "x", "y"), smooth.local_maxima(samples, "x"),
        edges.bouts(edges.derive(samples)), edges.bouts(edges.derive(samples), strict=True), edges.highlight_intervals(edges.derive(timed)), edges.deinterleave(timed, {"a": "level", "b": "level"}, "x", "time_s", 3), sampling.crop(samples, 3), align.present(samples, "x"), artifacts.in_segments(timed, artifacts.segments(timed, stops)),
    ):
        found = [x for x in sample_windows(plan(frame)) if " k#" not in x]  # the windows over the artifacts' list
        assert not found, found


def test_no_sequence_is_as_long_as_a_recording(spark):
    samples = spark.range(1000).select((F.col("id") % 2).alias("rec"), F.floor(F.col("id") / 2).alias("idx"), F.col("id").cast("double").alias("x")).withColumn("time_s", F.col("idx") / 10)
    stops = spark.createDataFrame([(0, 1, 3.0, 5.0)], "rec long, k int, start_s double, stop_s double")
    spans = spark.createDataFrame([(0, "Stim", "HC", 0, 3.0, 5.0)], "rec long, kind string, odor string, ordinal int, start_s double, stop_s double")
    pairs = spark.createDataFrame([(0, 1, 30, 50)], "rec long, bout long, idx_on long, idx_off long")
    for frame in (sampling.time_vector(samples, 10), sampling.resample_nearest(samples, samples, "x"), artifacts.in_segments(samples, artifacts.segments(samples, stops)), align.interval_samples(samples, spans, 10), stats.bout_stats(pairs, samples, "x")):
        made = [x for x in plan(frame).splitlines() if "Generate explode(sequence(" in x]
        # Numbers of blocks, or the numbers of one block.
        assert made and all("4096" in x.split("Generate explode(")[1] or "_block" in x.split("], ")[-1] for x in made), made


def test_no_frame_is_evaluated_anew_for_each_row(spark):
    for name in ("q_interp_linear", "q_bouts", "q_align_zip"):
        assert "unboundedfollowing$()), specifiedwindowframe(RowFrame, currentrow" not in plan(QUERIES[name](spark, DATA)) and "currentrow$(), unboundedfollowing$()" not in plan(QUERIES[name](spark, DATA)), name
