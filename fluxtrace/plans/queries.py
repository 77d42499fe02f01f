"""The registered queries of the recording engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import align, artifacts, blocks, dff, edges, fill, kernels, peth, runs, sampling, smooth, stats, transients
from ..sources import manifest, upsert
from .fixtures import ARTIFACTS, BOUTS_SQL, E_SQL, EDGES_SQL, INTERVALS, L_SQL, RATE, rec_e, rec_l, subjects, table, values_sql
from .fixtures import artifacts as artifact_rows
from .fixtures import intervals as interval_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


# --- sampling ---------------------------------------------------------------------------------


@query(f"with {E_SQL} select rec, count(*) as n, round(count(*) / nullif(max(time_s) - min(time_s), 0), 6) as samplerate from rec_e group by rec")
def q_samplerate(spark, sf_dir):
    """G1: sampling rate."""
    return rounded(sampling.sample_rate(rec_e(spark, sf_dir)), "samplerate")


@query(f"""with {E_SQL}, ends as (select rec, ceil(time_s) as d from (select *, row_number() over (partition by rec order by idx desc) as k from rec_e) where k = 2)
select rec, i, round(coalesce(i * d / nullif(floor(d * {RATE})::bigint, 0), 0.0), 6) as t from (select rec, d, unnest(generate_series(0, floor(d * {RATE})::bigint)) as i from ends)""")
def q_time_vector(spark, sf_dir):
    """Uniform time vector."""
    return rounded(sampling.time_vector(rec_e(spark, sf_dir), RATE), "t")


@query(f"with {E_SQL} select rec, row_number() over (partition by rec order by idx) - 1 as idx, x from rec_e where idx >= 100")
def q_crop(spark, sf_dir):
    """Rows from number 100 on, numbered anew."""
    return sampling.crop(rec_e(spark, sf_dir), 100).select("rec", "idx", "x")


@query(f"with {E_SQL} select rec, idx, x from rec_e where idx % 600 = 0")
def q_decimate(spark, sf_dir):
    """P10: every 600th row."""
    return sampling.decimate(rec_e(spark, sf_dir)).select("rec", "idx", "x")


@query(f"""with {E_SQL}, slow as (select rec, count(*) as m from rec_e where idx % 7 = 0 group by rec), fast as (select rec, count(*) as n from rec_e group by rec),
grid as (select rec, j, round_even(j * (n - 1) / (m - 1)::double, 0)::bigint as idx from (select rec, n, m, unnest(generate_series(0, m - 1)) as j from fast join slow using (rec)))
select rec, j, idx, x from grid join rec_e using (rec, idx)""")
def q_resample(spark, sf_dir):
    """A fast signal onto a slow grid by nearest index."""
    fast = rec_e(spark, sf_dir)
    return sampling.resample_nearest(fast, fast.where("idx % 7 = 0"), "x").select("rec", "j", "idx", "x")


@query(f"""with {E_SQL}, b as (select rec, arg_min(time_s, idx) as a, arg_max(time_s, idx) as b from rec_e where behaviour = 'view' group by rec)
select rec, trunc(a * 10) / 10.0::double as t_start, trunc(b * 10) / 10.0::double as t_stop from b""")
def q_camera_window(spark, sf_dir):
    """First and last sample with the gate open."""
    return sampling.camera_window(rec_e(spark, sf_dir), F.col("behaviour") == "view")


@query(f"with {E_SQL} select rec, min(idx) as idx from rec_e where round_even(time_s * 10, 0) = 123 group by rec")
def q_camera_start(spark, sf_dir):
    """First sample at a time given in tenths."""
    return sampling.camera_start(rec_e(spark, sf_dir), 12.3)


# --- edges and runs ---------------------------------------------------------------------------


@query(f"with {E_SQL}, {EDGES_SQL} select rec, idx, edge from edges")
def q_derive(spark, sf_dir):
    """First difference."""
    return edges.derive(rec_e(spark, sf_dir)).select("rec", "idx", "edge")


@query(f"with {E_SQL}, {EDGES_SQL} select rec, idx, coalesce(edge, 0) as edge from edges")
def q_derive_fill(spark, sf_dir):
    """First difference, filled with zero."""
    return edges.derive_filled(rec_e(spark, sf_dir)).select("rec", "idx", "edge")


def _runs_sql(source: str, name: str, target: int, least: int, most: int) -> str:
    return f"""{name}_c as (select rec, idx, level, coalesce((level <> lag(level) over (partition by rec order by idx))::int, 0) as ch from {source}),
{name}_r as (select *, sum(ch) over (partition by rec order by idx rows unbounded preceding) as run from {name}_c),
{name}_n as (select *, count(*) over (partition by rec, run) as n, max(run) over (partition by rec) as top from {name}_r),
{name} as (select rec, idx, case when level = {target} and n between {least} and {most} and run < top then {1 - target} else level end as level from {name}_n)"""


def _fused(spark, sf_dir, least):
    return runs.fuse(blocks.deal(rec_e(spark, sf_dir).select("rec", "idx", "level")), 0.3, RATE, least)


@query(f"with {E_SQL}, {_runs_sql('rec_e', 'fused', 0, 2, 3)} select rec, idx, level from fused")
def q_fuse_behav(spark, sf_dir):
    """Gap fusion of scored behaviour."""
    return _fused(spark, sf_dir, runs.BEHAVIOUR).drop("_block")


@query(f"with {E_SQL}, {_runs_sql('rec_e', 'fused', 0, 2, 3)}, {_runs_sql('fused', 'pruned', 1, 2, 4)} select rec, idx, level from pruned")
def q_prune_behav(spark, sf_dir):
    """Short bouts of scored behaviour cleared, after fusion."""
    return runs.prune(_fused(spark, sf_dir, runs.BEHAVIOUR), 0.4, RATE, runs.BEHAVIOUR).drop("_block")


@query(f"with {E_SQL}, {_runs_sql('rec_e', 'fused', 0, 1, 3)} select rec, idx, level from fused")
def q_fuse_sniff(spark, sf_dir):
    """Gap fusion of respiration intervals."""
    return _fused(spark, sf_dir, runs.SNIFFS).drop("_block")


@query(f"with {E_SQL}, {_runs_sql('rec_e', 'fused', 0, 1, 3)}, {_runs_sql('fused', 'pruned', 1, 1, 4)} select rec, idx, level from pruned")
def q_prune_sniff(spark, sf_dir):
    """Short respiration intervals cleared, after fusion."""
    return runs.prune(_fused(spark, sf_dir, runs.SNIFFS), 0.4, RATE, runs.SNIFFS).drop("_block")


@query(f"with {E_SQL}, {EDGES_SQL}, {BOUTS_SQL} select rec, bout, idx_on, idx_off from bouts where idx_off - idx_on > 1 and idx_off - idx_on >= 3")
def q_bouts(spark, sf_dir):
    """Onsets paired with offsets, kept by duration."""
    return edges.long_enough(edges.bouts(edges.derive(rec_e(spark, sf_dir))), 0.3, RATE)


@query(f"""with {E_SQL}, {EDGES_SQL}, w as (select *, last_value(case when edge = 1 and time_s <> 0 then time_s end ignore nulls) over (partition by rec order by idx rows unbounded preceding) as t_on,
last_value(case when edge = -1 then time_s end ignore nulls) over (partition by rec order by idx rows between unbounded preceding and 1 preceding) as before from edges)
select rec, t_on, time_s as t_off from w where edge = -1 and t_on is not null and (before is null or before < t_on)""")
def q_highlight(spark, sf_dir):
    """Intervals to shade in a plot."""
    return edges.highlight_intervals(edges.derive(rec_e(spark, sf_dir)))


_CLICKS = "clicks as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'click')"


@query(f"with {_CLICKS} select user_id, (k - 1) // 2 as pair, min(value) as start, max(value) as stop from clicks group by all having count(*) = 2")
def q_click_pairs(spark, sf_dir):
    """Clicks paired to intervals."""
    return edges.click_pairs(table(spark, sf_dir, "events").where("event_type = 'click'"), "user_id", ["ts", "event_id"], "value")


@query(f"with {E_SQL}, {EDGES_SQL} select rec, coalesce(sum((edge = 1)::int), 0)::bigint as n_on, coalesce(sum((edge = -1)::int), 0)::bigint as n_off, n_on = n_off as matched from edges group by rec")
def q_match_counts(spark, sf_dir):
    """Whether onsets and offsets match in number."""
    return stats.match_counts(edges.derive(rec_e(spark, sf_dir)))


def _gate_sql(name: str, flag: str) -> str:
    rise = f"(flag = '{flag}')::int - lag((flag = '{flag}')::int) over (partition by rec order by idx)"
    return f"{name} as (select rec, row_number() over (partition by rec order by idx) as k, later as {name}, tmax from (select *, {rise} as r, lead(case when idx % 13 <> 5 then sig end, 3) over (partition by rec order by idx) as later, max(time_s) over (partition by rec) as tmax, max(idx) over (partition by rec) as top from rec_l) where r = 1 and idx + 3 <= top)"


@query(f"""with {L_SQL}, {_gate_sql('ch405', 'R')}, {_gate_sql('ch470', 'A')}
select rec, k - 1 as idx, round(nullif(coalesce((k - 1) * tmax / nullif(count(*) over (partition by rec) - 1, 0), 0.0), 0.0), 9) as time_s, nullif(ch405, 0) as ch405, nullif(ch470, 0) as ch470
from (select rec, k, ch405, ch470, ch405.tmax as tmax from ch405 join ch470 using (rec, k))""")
def q_deinterleave(spark, sf_dir):
    """Two channels out of one, which has missing samples, by their gates."""
    raw = rec_l(spark, sf_dir).withColumn("sig", F.when(F.col("idx") % 13 != 5, F.col("sig"))).withColumn("r", (F.col("flag") == "R").cast("int")).withColumn("a", (F.col("flag") == "A").cast("int"))
    return edges.deinterleave(raw, {"ch405": "r", "ch470": "a"}, "sig", "time_s", 3).withColumn("time_s", F.round("time_s", 9))


# --- relative change --------------------------------------------------------------------------


@query(f"with {L_SQL} select rec, idx, round((sig - avg(sig) over (partition by rec)) / avg(sig) over (partition by rec) * 100, 6) as sig_dff from rec_l")
def q_dff_mean(spark, sf_dir):
    """Relative change by the mean."""
    return rounded(dff.dff_mean(rec_l(spark, sf_dir), "sig").select("rec", "idx", "sig_dff"), "sig_dff")


@query(f"with {L_SQL} select rec, round(regr_slope(sig, ctrl), 9) as slope, round(regr_intercept(sig, ctrl), 6) as intercept from rec_l group by rec")
def q_control_fit(spark, sf_dir):
    """Linear fit of the control."""
    return dff.fit_terms(rec_l(spark, sf_dir)).select("rec", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(f"""with {L_SQL}, t as (select rec, regr_slope(sig, ctrl) as a, regr_intercept(sig, ctrl) as b from rec_l group by rec)
select rec, idx, round(a * ctrl + b, 5) as fit, round((sig - (a * ctrl + b)) / nullif(a * ctrl + b, 0) * 100, 4) as denoised from rec_l join t using (rec)""")
def q_dff_fit(spark, sf_dir):
    """Relative change by the fitted control."""
    return dff.dff_fit(rec_l(spark, sf_dir)).select("rec", "idx", F.round("fit", 5).alias("fit"), F.round("denoised", 4).alias("denoised"))


_SEGMENTS = f"""art(rec, k, start_s, stop_s) as (values {values_sql(ARTIFACTS)}), n as (select rec, count(*) as n from rec_e group by rec),
bounds as (select rec, k, start_s, stop_s from art union all select n.rec, coalesce(max(k), 0) + 1, any_value(n.n)::double, null from n left join art using (rec) group by n.rec),
hits as (select b.rec, b.k, max(case when time_s < start_s then idx end) as e, min(case when time_s > stop_s then idx end) as a from rec_e r join bounds b on r.rec = b.rec group by all),
segs as (select rec, k, coalesce(last_value(case when e is not null then a end ignore nulls) over (partition by rec order by k rows between unbounded preceding and 1 preceding), 0) as b, e from hits)"""


@query(f"with {E_SQL}, {_SEGMENTS} select rec, k, b as \"begin\", e as \"end\" from segs where e is not null")
def q_artifact_segments(spark, sf_dir):
    """Segments between artifacts."""
    return artifacts.segments(rec_e(spark, sf_dir), artifact_rows(spark))


@query(f"""with {E_SQL}, {_SEGMENTS}, cover as (select rec, idx, max(k) as k from (select rec, k, unnest(generate_series(b + 1, e - 1)) as idx from segs where e - b > 1) group by all),
placed as (select r.rec, r.idx, r.x, c.k from rec_e r left join cover c on r.rec = c.rec and r.idx = c.idx)
select rec, idx, round(case when rec in (select rec from art) then case when k is not null then (x - avg(x) over (partition by rec, k)) / avg(x) over (partition by rec, k) * 100 end
else (x - avg(x) over (partition by rec)) / avg(x) over (partition by rec) * 100 end, 6) as clean from placed""")
def q_dff_artifacts(spark, sf_dir):
    """Relative change by segments where artifacts are listed, else over the whole recording."""
    return rounded(artifacts.dff_or_default(rec_e(spark, sf_dir), artifact_rows(spark), "x").select("rec", "idx", "clean"), "clean")


@query(f"""with {E_SQL}, {_SEGMENTS}, cover as (select rec, idx, max(k) as k from (select rec, k, unnest(generate_series(b + 1, e - 1)) as idx from segs where e - b > 1) group by all),
placed as (select r.rec, r.idx, r.x, r.time_s, c.k from rec_e r left join cover c on r.rec = c.rec and r.idx = c.idx),
terms as (select rec, k, regr_slope(x, time_s) as a, regr_intercept(x, time_s) as b from placed where k is not null group by all)
select p.rec, p.idx, round((x - (a * time_s + b)) / nullif(a * time_s + b, 0) * 100, 4) as clean from placed p left join terms t on t.rec = p.rec and t.k = p.k""")
def q_artifact_fit(spark, sf_dir):
    """Relative change by the line fitted to each segment."""
    rows = artifacts.remove_artifacts(rec_e(spark, sf_dir), artifact_rows(spark), "x", "fit", "time_s")
    return rows.select("rec", "idx", F.round("clean", 4).alias("clean"))


@query(f"""with {E_SQL}, w as (select *, max(case when g is not null then idx end) over (partition by rec order by idx rows unbounded preceding) as p, min(case when g is not null then idx end) over (partition by rec order by idx rows between current row and unbounded following) as q from rec_e)
select w.rec, w.idx, round(coalesce(w.g, a.g + (b.g - a.g) * ((w.idx - p) / nullif(q - p, 0)::double), a.g, b.g), 6) as filled
from w left join rec_e a on a.rec = w.rec and a.idx = p left join rec_e b on b.rec = w.rec and b.idx = q""")
def q_interp_linear(spark, sf_dir):
    """Linear interpolation by sample number."""
    return rounded(fill.interpolate(rec_e(spark, sf_dir), "g", "filled").select("rec", "idx", "filled"), "filled")


@query(f"with {E_SQL} select rec, idx, round(coalesce(g, avg(g) over (partition by rec)), 6) as filled from rec_e")
def q_mean_pad(spark, sf_dir):
    """Gaps filled with the mean."""
    return rounded(fill.mean_pad(rec_e(spark, sf_dir), "g", "filled").select("rec", "idx", "filled"), "filled")


@query(f"with {E_SQL} select rec, idx, nullif(level, 0) as level, nullif(time_s, 0) as time_s, coalesce(nullif(time_s, 0), 0) as time_back from rec_e")
def q_zero_to_null(spark, sf_dir):
    """Zeros to missing, and missing times back to zero."""
    rows = fill.zero_to_null(rec_e(spark, sf_dir), "level", "time_s").withColumn("time_back", F.coalesce("time_s", F.lit(0.0)))
    return rows.select("rec", "idx", "level", "time_s", "time_back")


# --- smoothing --------------------------------------------------------------------------------


@query(f"with {E_SQL} select rec, idx, round(avg(g) over (partition by rec order by idx rows 4 preceding), 6) as sma from rec_e")
def q_sma(spark, sf_dir):
    """Trailing moving average."""
    return rounded(smooth.moving_average(rec_e(spark, sf_dir), "g", 5, "sma").select("rec", "idx", "sma"), "sma")


@query(f"""with {E_SQL}, w as (select rec, idx, x, list(x) over f as win, count(*) over f as n, median(x) over f as med from rec_e window f as (partition by rec order by idx rows between 5 preceding and 5 following))
select rec, idx, round(case when n = 11 and abs(x - med) > 5.0 * (1.4826 * list_median(list_transform(win, lambda v: abs(v - med)))) then med else x end, 6) as clean from w""".replace("list_median(", "list_aggregate(").replace("abs(v - med)))) then", "abs(v - med)), 'median')) then"))
def q_hampel(spark, sf_dir):
    """Hampel filter."""
    return rounded(smooth.hampel(rec_e(spark, sf_dir), "x", "clean").select("rec", "idx", "clean"), "clean")


@query(f"with {E_SQL}, t as (select rec, regr_slope(x, idx) as a, regr_intercept(x, idx) as b from rec_e group by rec) select rec, idx, round(x - (a * idx + b), 6) as flat from rec_e join t using (rec)")
def q_detrend(spark, sf_dir):
    """Linear detrend."""
    return rounded(smooth.detrend(rec_e(spark, sf_dir), "x", "flat").select("rec", "idx", "flat"), "flat")


@query(f"with {E_SQL}, m as (select rec, median(x) as median from rec_e group by rec) select rec, round(any_value(median), 6) as median, round(median(abs(x - median)), 6) as mad from rec_e join m using (rec) group by rec")
def q_mad(spark, sf_dir):
    """Median absolute deviation."""
    return rounded(smooth.median_deviation(rec_e(spark, sf_dir), "x"), "median", "mad")


@query(f"""with {E_SQL}, c as (select rec, idx, x, coalesce((x <> lag(x) over (partition by rec order by idx))::int, 0) as ch from rec_e), r as (select *, sum(ch) over (partition by rec order by idx rows unbounded preceding) as run from c),
g as (select rec, run, min(idx) as a, max(idx) as b, min(x) as height from r group by all), n as (select *, lag(height) over (partition by rec order by run) as before, lead(height) over (partition by rec order by run) as after from g)
select rec, (a + b) // 2 as idx, height from n where height > before and height > after""")
def q_local_maxima(spark, sf_dir):
    """W12 without distance: maxima and middles of plateaus."""
    return smooth.local_maxima(rec_e(spark, sf_dir), "x")


# --- alignment --------------------------------------------------------------------------------

_STIMS = f"""iv(rec, kind, odor, sheet_row, start_s, stop_s) as (values {values_sql(INTERVALS)}),
numbered as (select *, row_number() over (partition by rec, kind, odor order by sheet_row) - 1 as ordinal from iv),
tops as (select rec, count(*) - 1 as top from rec_e group by rec),
ends as (select rec, kind, odor, ordinal, greatest(0, least(round_even(start_s * 10, 0)::bigint, top)) as i0, greatest(0, least(round_even(stop_s * 10, 0)::bigint, top)) as i1 from numbered join tops using (rec) where not (start_s = 0 and stop_s = 0)),
stim as (select distinct rec, kind, odor, ordinal, unnest(generate_series(i0, i1)) as idx from ends where i1 > i0)"""


def _stim_samples(spark, sf_dir):
    return align.interval_samples(rec_e(spark, sf_dir), align.number_intervals(interval_rows(spark), "sheet_row"), RATE)


@query(f"""with {E_SQL}, starts as (select rec, min(idx) as start from rec_e where round_even(time_s * 10, 0) = 21 group by rec), tr as (select rec, row_number() over (partition by rec order by idx) - 1 as idx, g from rec_e where g is not null)
select t.rec, t.idx, round(e.time_s, 6) as t, t.g, coalesce(b.level, 0) as level
from tr t join rec_e e on e.rec = t.rec and e.idx = t.idx join starts s on s.rec = t.rec left join rec_e b on b.rec = t.rec and b.idx + s.start = t.idx where t.idx < s.start or b.level is not null""")
def q_align_zip(spark, sf_dir):
    """Behaviour laid beside a trace, shifted by the camera's start."""
    e = rec_e(spark, sf_dir)
    starts = sampling.camera_start(e, 2.1).withColumnRenamed("idx", "start")
    return rounded(align.align_behaviour(e, ["g"], e, starts, e.select("rec", "idx", F.col("time_s").alias("t"))), "t")


@query(f"with {E_SQL}, {_STIMS} select rec, kind, odor, ordinal, idx from stim")
def q_stim_columns(spark, sf_dir):
    """Intervals in seconds to samples."""
    return _stim_samples(spark, sf_dir)


@query(f"with {E_SQL}, {_STIMS} select rec, idx, kind, odor, count(*) as level from stim group by all")
def q_rollup(spark, sf_dir):
    """Levels of an odor's intervals added up."""
    return align.roll_up(_stim_samples(spark, sf_dir).withColumn("level", F.lit(1)))


@query(f"with {E_SQL}, {_STIMS} select distinct rec, kind, odor, ordinal, contains(kind || ' ' || odor || ' ' || ordinal, 'Clean 1') as part, starts_with(kind || ' ' || odor || ' ' || ordinal, 'Sniff Clean') as prefix from stim where contains(kind || ' ' || odor || ' ' || ordinal, 'Clean 1') or starts_with(kind || ' ' || odor || ' ' || ordinal, 'Sniff Clean')")
def q_by_name(spark, sf_dir):
    """P5: intervals by a part of their name, and by its beginning."""
    names = _stim_samples(spark, sf_dir).select("rec", "kind", "odor", "ordinal").distinct()
    keys = ["rec", "kind", "odor", "ordinal"]
    part = align.by_name(names, part="Clean 1").withColumn("part", F.lit(True))
    prefix = align.by_name(names, prefix="Sniff Clean").withColumn("prefix", F.lit(True))
    return part.join(prefix, keys, "full").fillna(False, ["part", "prefix"])


@query(f"with {E_SQL} select rec, idx, time_s, x from rec_e where time_s > 40")
def q_plot_trace(spark, sf_dir):
    """V2, F2: what the plot of a trace shows."""
    return stats.after_warm_up(rec_e(spark, sf_dir), 40.0).select("rec", "idx", "time_s", "x")


@query(f"""with {E_SQL}, slow as (select rec, time_s, x, row_number() over (partition by rec order by idx) - 1 as j, count(*) over (partition by rec) as m from rec_e where idx % 7 = 0), fast as (select rec, count(*) as n from rec_e group by rec)
select s.rec, j, s.time_s, s.x as dff, e.x as breath from slow s join fast f on f.rec = s.rec join rec_e e on e.rec = s.rec and e.idx = case when m > 1 then round_even(j * (n - 1) / (m - 1)::double, 0)::bigint else 0 end""")
def q_plot_respiration(spark, sf_dir):
    """V6: a trace with the respiration, sampled faster, beside it."""
    fast = rec_e(spark, sf_dir)
    slow = sampling.by_sample()
    trace = fast.where("idx % 7 = 0").select("rec", (F.row_number().over(slow) - 1).cast("long").alias("j"), "time_s", F.col("x").alias("dff"))
    breath = sampling.resample_nearest(fast, trace, "x").select("rec", "j", F.col("x").alias("breath"))
    return trace.join(breath, ["rec", "j"])


# --- statistics -------------------------------------------------------------------------------


@query(f"""with {E_SQL} select rec, behaviour, sum(level)::bigint as active, round(case when sum(level) > 2 then avg(case when level = 1 then x end) end, 6) as mean from rec_e where time_s > 15 group by all""")
def q_state_means(spark, sf_dir):
    """Means by state after the warm-up."""
    return rounded(stats.state_means(stats.after_warm_up(rec_e(spark, sf_dir)), "behaviour", "level", "x"), "mean")


@query(f"""with {E_SQL}, c as (select * from rec_e where time_s > 15), s as (select rec, coalesce(min(case when behaviour = 'signup' then idx end), 0) as start from c group by rec)
select rec, start, round(avg(case when idx <= start then x end), 6) as baseline, round(avg(case when idx >= start and level = 0 then x end), 6) as post_baseline, round(avg(case when level = 0 then x end), 6) as mean_idle from c join s using (rec) group by all""")
def q_period_means(spark, sf_dir):
    """Means before and after the first mark, outside behaviour."""
    rows = stats.after_warm_up(rec_e(spark, sf_dir))
    return rounded(stats.period_means(rows, F.col("behaviour") == "signup", F.col("level") == 0, "x"), "baseline", "post_baseline", "mean_idle")


_BOUT_STATS = """inside as (select b.rec, b.bout, avg(x) as mean, max(x) as max from bouts b join rec_e r on r.rec = b.rec and r.idx between b.idx_on and b.idx_off group by all),
near as (select rec, idx, avg(x) over (partition by rec order by idx rows between 5 preceding and 5 following) as local from rec_e),
detail as (select b.rec, b.bout, b.idx_on, b.idx_off, i.mean, i.max, case when b.idx_off >= b.idx_on then q.local - p.local end as delta
from bouts b left join inside i using (rec, bout) left join near p on p.rec = b.rec and p.idx = b.idx_on left join near q on q.rec = b.rec and q.idx = b.idx_off)"""


def _bout_detail(spark, sf_dir):
    e = rec_e(spark, sf_dir)
    return stats.bout_stats(edges.bouts(edges.derive(e)), e, "x")


@query(f"with {E_SQL}, {EDGES_SQL}, {BOUTS_SQL}, {_BOUT_STATS} select rec, bout, idx_on, idx_off, round(mean, 6) as mean, round(max, 6) as max, round(delta, 6) as delta from detail")
def q_bout_detail(spark, sf_dir):
    """Figures of each bout."""
    return rounded(_bout_detail(spark, sf_dir), "mean", "max", "delta")


@query(f"with {E_SQL}, {EDGES_SQL}, {BOUTS_SQL}, {_BOUT_STATS} select rec, count(*) as n_bouts, round(avg(mean), 6) as mean, round(avg(max), 6) as max, round(avg(delta), 6) as delta from detail group by rec")
def q_bout_stats(spark, sf_dir):
    """Figures of bouts averaged by recording."""
    return rounded(stats.mean_over_bouts(_bout_detail(spark, sf_dir)), "mean", "max", "delta")


@query(f"""with {E_SQL}, s as (select rec, coalesce(min(case when behaviour = 'purchase' then idx end), 0) as start from rec_e where time_s > 15 group by rec)
select rec, round(var_pop(x), 6) as var_all, round(var_pop(case when idx < start then x end), 6) as var_baseline, round(var_pop(case when idx >= start then x end), 6) as var_post from rec_e join s using (rec) where time_s > 15 group by rec""")
def q_variance_periods(spark, sf_dir):
    """Population variances by period."""
    rows = stats.after_warm_up(rec_e(spark, sf_dir))
    return rounded(stats.variance_periods(rows, F.col("behaviour") == "purchase", "x"), "var_all", "var_baseline", "var_post")


def _signups(spark, sf_dir, name="signup"):
    e = rec_e(spark, sf_dir)
    events = e.where(F.col("behaviour") == name).select("rec", "idx", F.row_number().over(sampling.by_sample()).cast("long").alias("bout"))
    return e, events


_SIGNUPS = "ev as (select rec, idx, row_number() over (partition by rec order by idx) as bout from rec_e where behaviour = 'signup')"
_AROUND = "around as (select v.rec, v.bout, r.idx - v.idx as d, r.x from ev v join rec_e r on r.rec = v.rec and r.idx between v.idx - 5 and v.idx + 5)"
_BA = "select rec, bout, round(avg(case when d <= 0 then x end), 6) as mean_before, round(avg(case when d >= 0 then x end), 6) as mean_after, round(max(case when d <= 0 then x end), 6) as max_before, round(max(case when d >= 0 then x end), 6) as max_after from around group by rec, bout"


@query(f"with {E_SQL}, {_SIGNUPS}, {_AROUND} {_BA}")
def q_before_after(spark, sf_dir):
    """Means and maxima around every event."""
    e, events = _signups(spark, sf_dir)
    return rounded(stats.before_after(events, e, 5, "x"), "mean_before", "mean_after", "max_before", "max_after")


@query(f"with {E_SQL}, {_SIGNUPS}, {_AROUND}, ba as ({_BA}) select * from ba qualify row_number() over (partition by rec order by bout desc) = 1")
def q_before_after_last(spark, sf_dir):
    """The same, of each recording's last event."""
    e, events = _signups(spark, sf_dir)
    return rounded(stats.last_event(stats.before_after(events, e, 5, "x")), "mean_before", "mean_after", "max_before", "max_after")


@query(f"with {E_SQL}, {_STIMS}, lv as (select rec, idx, kind, odor, count(*) as level from stim group by all) select l.rec, kind, odor, count(*) as n, round(avg(x), 6) as mean from lv l join rec_e r on r.rec = l.rec and r.idx = l.idx where l.level = 1 group by all")
def q_sniff_means(spark, sf_dir):
    """Means where the summed level is exactly one."""
    states = align.roll_up(_stim_samples(spark, sf_dir).withColumn("level", F.lit(1)))
    return rounded(stats.exact_level_means(states, rec_e(spark, sf_dir), "x"), "mean")


@query(f"""with {E_SQL}, ev as (select rec, min(idx) as e from rec_e where behaviour = 'signup' group by rec), w as (select v.rec, r.idx - v.e as d, x from ev v join rec_e r on r.rec = v.rec and r.idx >= v.e - 20 and r.idx < v.e + 20)
select rec, round(avg(case when d < 0 then x end), 6) as mean_before, round(avg(case when d >= 0 then x end), 6) as mean_during, round(max(case when d < 0 then x end), 6) as max_before, round(max(case when d >= 0 then x end), 6) as max_during from w group by rec""")
def q_stim_beforeafter(spark, sf_dir):
    """Means and maxima before and during the first event."""
    e, events = _signups(spark, sf_dir)
    return rounded(stats.before_during(events, e, 20, "x"), "mean_before", "mean_during", "max_before", "max_during")


# --- event-triggered averages -----------------------------------------------------------------

_KEPT = """kept as (select rec, bout, idx_on as idx from bouts where idx_off - idx_on > 1 and idx_off - idx_on >= 3 and idx_on + 20 < (select count(*) from rec_e r where r.rec = bouts.rec))"""
_TROUGH = """moved as (select k.rec, k.bout, arg_min(r.idx, struct_pack(v := r.x, i := r.idx)) as idx from kept k join rec_e r on r.rec = k.rec and r.idx between k.idx + {lo} and k.idx + {hi} group by all)"""
_WHOLE = """zs as (select rec, avg(x) as mu, stddev_samp(x) as sd from rec_e group by rec),
win as (select m.rec, m.bout, m.idx, r.idx - m.idx as rel_idx, (r.x - mu) / nullif(sd, 0) as z, count(*) over (partition by m.rec, m.bout) as n from {src} m join rec_e r on r.rec = m.rec and r.idx between m.idx - 10 and m.idx + 20 join zs on zs.rec = m.rec),
pz as (select rec, bout, idx, rel_idx, z from win where n = 31)"""
_PETH = f"{E_SQL}, {EDGES_SQL}, {BOUTS_SQL}, {_KEPT}, {_TROUGH.format(lo=-10, hi=10)}, {_WHOLE.format(src='moved')}"
_AVERAGE = "count(z) as n, round(avg(z), 6) as mean_z, round(stddev_pop(z) / sqrt(nullif(count(z), 0)), 6) as sem_z"


def _events(spark, sf_dir):
    e = rec_e(spark, sf_dir)
    found = edges.long_enough(edges.bouts(edges.derive(e)), 0.3, RATE).withColumnRenamed("idx_on", "idx")
    return e, peth.early_enough(found, e, 20).select("rec", "bout", "idx")


def _peth(spark, sf_dir):
    e, events = _events(spark, sf_dir)
    return peth.peth(peth.shift_to_trough(events, e, -10, 10, "x"), e, 10, 20, "x")


@query(f"with {_PETH} select rel_idx, {_AVERAGE} from pz group by rel_idx")
def q_peth_mean(spark, sf_dir):
    """The average over all bouts."""
    return rounded(peth.average(_peth(spark, sf_dir)), "mean_z", "sem_z")


@query(f"with {_PETH} select rec, bout, idx, rel_idx, round(z, 6) as z from pz where bout <= 5")
def q_peth_rows(spark, sf_dir):
    """The rows of the first five bouts."""
    e, events = _events(spark, sf_dir)
    moved = peth.shift_to_trough(peth.first_events(events, 5), e, -10, 10, "x")
    return rounded(peth.peth(moved, e, 10, 20, "x"), "z")


@query(f"""with {E_SQL}, {EDGES_SQL}, {BOUTS_SQL}, {_KEPT}, win as (select m.rec, m.bout, r.idx - m.idx as rel_idx, r.x, count(*) over (partition by m.rec, m.bout) as n from kept m join rec_e r on r.rec = m.rec and r.idx between m.idx - 10 and m.idx + 20),
b as (select rec, bout, avg(x) as mu, stddev_samp(x) as sd from win where rel_idx between -10 and -2 group by all)
select rec, bout, rel_idx, round((x - mu) / nullif(sd, 0), 6) as z from win join b using (rec, bout) where n = 31""")
def q_peth_baseline(spark, sf_dir):
    """Z-scores by a window before each event."""
    e, events = _events(spark, sf_dir)
    return rounded(peth.peth(events, e, 10, 20, "x", (-10, -2)), "z").drop("idx")


@query(f"""with {E_SQL}, flat_e as (select * replace (case when rec = 3 then 7.5 else x end as x) from rec_e), {EDGES_SQL}, {BOUTS_SQL}, {_KEPT.replace('idx_off - idx_on > 1 and idx_off - idx_on >= 3 and ', '').replace('idx_on + 20', 'idx_on + 0')}, {_TROUGH.format(lo=-10, hi=0).replace('join rec_e', 'join flat_e')}, {_WHOLE.format(src='moved').replace('(r.x - mu) / nullif(sd, 0)', 'case when sd > 0 then (r.x - mu) / sd else r.x end').replace('from rec_e', 'from flat_e').replace('join rec_e', 'join flat_e')} select rel_idx, {_AVERAGE} from pz group by rel_idx""")
def q_peth_sniff(spark, sf_dir):
    """Onsets moved to the trough before them, no duration filter; a flat trace as it is."""
    e = rec_e(spark, sf_dir).withColumn("x", F.when(F.col("rec") == 3, 7.5).otherwise(F.col("x")))
    events = edges.bouts(edges.derive(e)).select("rec", "bout", F.col("idx_on").alias("idx"))
    return rounded(peth.average(peth.peth(peth.shift_to_trough(events, e, -10, 0, "x"), e, 10, 20, "x", raw_if_flat=True)), "mean_z", "sem_z")


@query(f"with {E_SQL}, {_SIGNUPS}, {_WHOLE.format(src='ev')} select rel_idx, {_AVERAGE} from pz group by rel_idx")
def q_peth_stim(spark, sf_dir):
    """Events as they are."""
    e, events = _signups(spark, sf_dir)
    return rounded(peth.average(peth.peth(events, e, 10, 20, "x")), "mean_z", "sem_z")


@query(f"with {_PETH}, each as (select rec, rec % 2 as grp, rel_idx, avg(z) as z from pz group by all) select grp, rel_idx, {_AVERAGE} from each group by all")
def q_peth_pool(spark, sf_dir):
    """Means of recordings' means by group."""
    groups = spark.range(8).select(F.col("id").alias("rec"), (F.col("id") % 2).alias("grp"))
    return rounded(peth.pool(_peth(spark, sf_dir), groups), "mean_z", "sem_z")


@query(f"with {_PETH} select rec, bout, round(avg(case when rel_idx < 0 then z end), 6) as mean_before, round(avg(case when rel_idx >= 0 then z end), 6) as mean_after, round(max(case when rel_idx < 0 then z end), 6) as max_before, round(max(case when rel_idx >= 0 then z end), 6) as max_after from pz group by all")
def q_peth_meanmax(spark, sf_dir):
    """Mean and maximum before and after."""
    return rounded(peth.mean_max(_peth(spark, sf_dir)), "mean_before", "mean_after", "max_before", "max_after")


@query(f"with {_PETH} select rec, rel_idx, count(z) as n, round(avg(z), 6) as mean_z, round(stddev_pop(z), 6) as sd_z from pz group by all")
def q_plot_peth(spark, sf_dir):
    """V8: the mean over a recording's bouts and the deviation around it."""
    return rounded(peth.spread(_peth(spark, sf_dir), "rec"), "mean_z", "sd_z")


def _odor_sql(event: str) -> str:
    edge = "idx - 1 as here, lag(idx) over w as beside" if event == "onset" else "idx + 1 as here, lead(idx) over w as beside"
    kept = "beside is distinct from idx - 1 and idx > 0" if event == "onset" else "beside is distinct from idx + 1 and here <= top"
    at = "idx" if event == "onset" else "here"
    return f"""{E_SQL}, {_STIMS}, sides as (select rec, odor, ordinal, idx, {edge} from stim where kind = 'Sniff' window w as (partition by rec, odor, ordinal order by idx)),
kept as (select rec, odor, {at} as idx, row_number() over (partition by rec order by odor, ordinal, {at}) as bout from sides join tops using (rec) where {kept})"""


@query(f"with {_odor_sql('onset')}, {_TROUGH.format(lo=-10, hi=0)}, {_WHOLE.format(src='moved')} select odor, rel_idx, {_AVERAGE} from pz join (select rec, bout, odor from kept) using (rec, bout) group by odor, rel_idx")
def q_peth_odor(spark, sf_dir):
    """The sniffs of an odor, whatever their number, pooled."""
    e = rec_e(spark, sf_dir)
    events = align.interval_events(align.by_name(_stim_samples(spark, sf_dir), prefix="Sniff "), e)
    rows = peth.peth(peth.shift_to_trough(events.select("rec", "bout", "idx"), e, -10, 0, "x"), e, 10, 20, "x")
    return rounded(peth.average(rows.join(events.select("rec", "bout", "odor"), ["rec", "bout"]), "odor"), "mean_z", "sem_z")


@query(f"with {_odor_sql('withdrawal')} select rec, odor, idx, bout from kept")
def q_sniff_ends(spark, sf_dir):
    """Withdrawals, the first samples after sniffs."""
    e = rec_e(spark, sf_dir)
    return align.interval_events(align.by_name(_stim_samples(spark, sf_dir), prefix="Sniff "), e, "withdrawal").select("rec", "odor", "idx", "bout")


@query(f"with {_PETH} select rec, rel_idx, " + ", ".join(f"round(max(case when bout = {b} then z end), 6) as bout_{b}" for b in (1, 2, 3)) + " from pz where bout in (1, 2, 3) group by all")
def q_peth_wide(spark, sf_dir):
    """Time by bouts."""
    return rounded(peth.wide(_peth(spark, sf_dir), [1, 2, 3]), "bout_1", "bout_2", "bout_3")


# --- kernels ----------------------------------------------------------------------------------


def _butter_sql() -> str:
    sections = kernels.butterworth(4, 1.0, RATE).tolist()
    out, source, column = [], "rec_e", "x"
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        y = f"{b0!r} * s.{column} + f.z1"
        first = f"{b0!r} * {column}"
        out.append(
            f"f{k} as (select rec, idx, {first} as y, {b1!r} * {column} - {a1!r} * ({first}) as z1, {b2!r} * {column} - {a2!r} * ({first}) as z2 from {source} where idx = 0"
            f" union all select s.rec, s.idx, {y}, {b1!r} * s.{column} - {a1!r} * ({y}) + f.z2, {b2!r} * s.{column} - {a2!r} * ({y}) from f{k} f join {source} s on s.rec = f.rec and s.idx = f.idx + 1)"
        )
        source, column = f"f{k}", "y"
    return f"with recursive {E_SQL}, {', '.join(out)} select rec, idx, round(y, 6) as filtered from {source}"


@query(_butter_sql())
def q_butter(spark, sf_dir):
    """Causal low-pass of order 4 at 1 Hz."""
    return rounded(kernels.low_pass(rec_e(spark, sf_dir), "x", rate=RATE).select("rec", "idx", "filtered"), "filtered")


def _cascade_sql(name: str, source: str, sections: list, states: list) -> list[str]:
    """Sections one after another over source (rec, idx, y), each from its state times the source's first value."""
    out, before = [], source
    for k, ((b0, b1, b2, _, a1, a2), (s1, s2)) in enumerate(zip(sections, states, strict=True)):
        here = f"{name}{k}"
        first, later = f"{b0!r} * b.y + {s1!r} * p.y", f"{b0!r} * b.y + f.z1"
        out.append(
            f"{here} as (select b.rec, b.idx, {first} as y, {b1!r} * b.y - {a1!r} * ({first}) + {s2!r} * p.y as z1, {b2!r} * b.y - {a2!r} * ({first}) as z2 from {before} b join {source} p on p.rec = b.rec and p.idx = 0 where b.idx = 0"
            f" union all select b.rec, b.idx, {later}, {b1!r} * b.y - {a1!r} * ({later}) + f.z2, {b2!r} * b.y - {a2!r} * ({later}) from {here} f join {before} b on b.rec = f.rec and b.idx = f.idx + 1)"
        )
        before = here
    return out


def _zero_phase_sql(sections, pad: int) -> str:
    """Forward and backward over ends extended oddly by pad samples."""
    states, sections = kernels.step_state(sections).tolist(), sections.tolist()
    top = len(sections) - 1
    parts = [
        E_SQL,
        "ends as (select rec, count(*) as n, arg_min(x, idx) as x0, arg_max(x, idx) as x1 from rec_e group by rec)",
        f"""ahead as (select rec, idx + {pad} as idx, x as y from rec_e union all select rec, {pad} - idx, 2 * x0 - x from rec_e join ends using (rec) where idx between 1 and {pad}
union all select rec, {pad} + 2 * (n - 1) - idx, 2 * x1 - x from rec_e join ends using (rec) where idx between n - 1 - {pad} and n - 2)""",
        *_cascade_sql("f", "ahead", sections, states),
        f"back as (select rec, n + {2 * pad - 1} - idx as idx, y from f{top} join ends using (rec))",
        *_cascade_sql("g", "back", sections, states),
    ]
    return f"with recursive {', '.join(parts)} select rec, n + {pad - 1} - idx as idx, round(y, 4) as filtered, 'ok' as status from g{top} join ends using (rec) where n + {pad - 1} - idx between 0 and n - 1"


@query(_zero_phase_sql(kernels.butterworth(3, (0.05, 0.5), RATE, "band"), 21))
def q_bandpass(spark, sf_dir):
    """Zero-phase band-pass."""
    return kernels.band_pass(rec_e(spark, sf_dir), "x", 0.05, 0.5, RATE).withColumn("filtered", F.round("filtered", 4))


@query(_zero_phase_sql(kernels.butterworth(2, 1.0, RATE, "high"), 9))
def q_highpass(spark, sf_dir):
    """Zero-phase high-pass."""
    return kernels.high_pass(rec_e(spark, sf_dir), "x", 1.0, RATE).withColumn("filtered", F.round("filtered", 4))


def _peaks_sql(deviations: float) -> str:
    """kept(rec, idx, height): the highest peak left removes those less than five samples away, and so on."""
    return f"""{E_SQL}, c as (select rec, idx, x, coalesce((x <> lag(x) over (partition by rec order by idx))::int, 0) as ch from rec_e),
r as (select *, sum(ch) over (partition by rec order by idx rows unbounded preceding) as run from c),
g as (select rec, run, min(idx) as a, max(idx) as b, min(x) as height from r group by all),
n as (select *, lag(height) over (partition by rec order by run) as before, lead(height) over (partition by rec order by run) as after from g),
m as (select rec, median(x) as median from rec_e group by rec), d as (select rec, any_value(median) as median, median(abs(x - median)) as mad from rec_e join m using (rec) group by rec),
high as (select rec, (a + b) // 2 as idx, height from n join d using (rec) where height > before and height > after and height >= median + {deviations} * mad),
todo as (select rec, list(struct_pack(i := idx, h := height) order by height desc, idx desc) as rest from high group by rec
union all select rec, list_filter(rest, lambda p: abs(p.i - rest[1].i) >= 5) from todo where len(rest) > 0),
kept as (select rec, rest[1].i as idx, rest[1].h as height from todo where len(rest) > 0)"""


@query(f"with recursive {_peaks_sql(1.0)} select rec, idx, height from kept")
def q_peaks(spark, sf_dir):
    """Peaks over the threshold, spaced by half a second."""
    return transients.peaks(rec_e(spark, sf_dir), "x", RATE)


@query(f"with recursive {_peaks_sql(1.0)} select e.rec, e.idx, (k.idx is not null)::int as peak from rec_e e left join kept k on k.rec = e.rec and k.idx = e.idx")
def q_mark_peaks(spark, sf_dir):
    """Peaks as a column of zeros and ones."""
    e = rec_e(spark, sf_dir)
    return transients.mark_peaks(e, transients.peaks(e, "x", RATE)).select("rec", "idx", "peak")


@query(f"""with recursive {_peaks_sql(2.0)}, s as (select rec, max(time_s) - min(time_s) as span from rec_e group by rec)
select rec, count(k.idx) as n_peaks, round(count(k.idx) / nullif(any_value(span), 0), 6) as frequency, round(avg(height), 6) as mean_height from s left join kept k using (rec) group by rec""")
def q_transients(spark, sf_dir):
    """Number, frequency and mean height of peaks."""
    return rounded(transients.transients(rec_e(spark, sf_dir), "x", RATE, "two_MAD"), "frequency", "mean_height")


@query(f"""with {E_SQL}, w as (select j, 0.5::double - 0.5::double * cos(2 * pi() * j / 1023) as w from (select unnest(generate_series(0, 1023)) as j)),
sizes as (select rec, greatest(count(*), 1024) // 1024 as parts from rec_e group by rec),
v as (select rec, idx // 1024 as part, j, coalesce(x, 0) * w as v from rec_e join w on j = idx % 1024 join sizes using (rec) where idx // 1024 < parts),
d as (select rec, part, bin, sum(v * cos(2 * pi() * ((bin * j) % 1024) / 1024)) as re, sum(v * sin(2 * pi() * ((bin * j) % 1024) / 1024)) as im from v cross join (select unnest(generate_series(0, 512)) as bin) group by all)
select rec, bin, bin * 10 / 1024::double as freq, round(avg(re * re + im * im) / (10 * (select sum(w * w) from w)) * case when bin in (0, 512) then 1 else 2 end, 4) as power from d group by rec, bin""")
def q_psd(spark, sf_dir):
    """Power spectral density."""
    return kernels.spectrum(rec_e(spark, sf_dir), "x", RATE).withColumn("power", F.round("power", 4))


# --- dimensions, manifests, tables ------------------------------------------------------------

_DIM = "dim as (select s_suppkey as rec, s_name as subject, n_regionkey as grp, r_name as batch from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


@query(f"with {L_SQL}, {_DIM} select d.rec, subject, grp, batch, count(*) as n, round(avg(sig), 6) as mean_sig from rec_l l join dim d on d.rec = l.rec group by all")
def q_subject_lookup(spark, sf_dir):
    """Recordings with their subject, group and batch."""
    means = rec_l(spark, sf_dir).groupBy("rec").agg(F.count("*").alias("n"), F.avg("sig").alias("mean_sig"))
    return rounded(means.join(subjects(spark, sf_dir), "rec"), "mean_sig").select("rec", "subject", "grp", "batch", "n", "mean_sig")


@query(f"with {L_SQL} select rec, count(*) as n from rec_l where rec in (select s_suppkey from supplier where s_acctbal > 0) group by rec")
def q_semi_subjects(spark, sf_dir):
    """Recordings of the subjects in another table."""
    wanted = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("rec"))
    return rec_l(spark, sf_dir).join(wanted, "rec", "left_semi").groupBy("rec").agg(F.count("*").alias("n"))


_PROTOCOL = [("Fear", "AFRICA", "S1,S2"), ("Fear", "ASIA", "Training,Test 24h,Other"), ("Odor", "EUROPE", "S3")]


def _protocol(spark):
    return spark.createDataFrame(_PROTOCOL, "task string, batch string, sessions string")


@query(f"""with {_DIM}, proto(task, batch, sessions) as (values {values_sql(_PROTOCOL)}), each as (select task, batch, unnest(string_split(sessions, ',')) as session from proto where task = 'Fear')
select d.rec, subject, e.batch, session, case when session in ('Conditioning', 'Habituation', 'S1', 'Training') then '0' when session in ('S2', 'Test', 'Test 1h', 'Test1') then '1' when session in ('S3', 'Test 24h', 'Test2') then '2' else 'Unknown' end as code, 'Fear_' || session || '_' || subject as filecode from dim d join each e on e.batch = d.batch""")
def q_manifest_cross(spark, sf_dir):
    """The sessions of an experiment for every subject of its batches."""
    return manifest.session_manifest(_protocol(spark), subjects(spark, sf_dir), "Fear")


@query(f"with {_DIM} select '/data/' || batch as folder, count(*) as n from dim group by batch having count(*) > 1")
def q_folder_guard(spark, sf_dir):
    """Folders that hold more than one file."""
    return manifest.folders(subjects(spark, sf_dir).select(F.concat(F.lit("/data/"), "batch", F.lit("/"), "subject", F.lit(".csv")).alias("path")))


@query(f"with {_DIM} select count(*) filter (where rec % 3 <> 0) as waiting, count(*) filter (where rec % 3 = 0) as done from dim")
def q_ready_manifest(spark, sf_dir):
    """Inputs without an output yet."""
    inputs = subjects(spark, sf_dir).select("rec")
    waiting = manifest.waiting(inputs, inputs.where("rec % 3 = 0"), "rec")
    return inputs.join(waiting.withColumn("open", F.lit(1)), "rec", "left").agg(F.count("open").alias("waiting"), F.sum(F.col("open").isNull().cast("long")).alias("done"))


@query("select distinct n_regionkey as grp from nation")
def q_distinct_groups(spark, sf_dir):
    """Distinct values."""
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("grp")).distinct()


@query(f"with {E_SQL} select rec, idx, behaviour as name, level from (unpivot (select rec, idx, level as a, 1 - level as b from rec_e) on a, b into name behaviour value level)")
def q_unpivot(spark, sf_dir):
    """A table with a column for each behaviour made long."""
    wide = rec_e(spark, sf_dir).select("rec", "idx", F.col("level").alias("a"), (1 - F.col("level")).alias("b"))
    return wide.unpivot(["rec", "idx"], ["a", "b"], "name", "level")


_SHEET = "select 'f' || (user_id % 500)::varchar as filecode, event_id as k, value as v, user_id, event_type from events"


def _lists_sql(which: str) -> str:
    return f"""sheet as ({_SHEET}), lists as (
    select filecode, '[' || string_agg(format('({{:.2f}}, {{:.2f}})', v, v + 1.25), ', ' order by k) || ']' as artifacts
    from sheet where {which} group by filecode)"""


def _lists(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """(filecode, artifacts): interval lists as text, as a sheet of artifacts has them, written from some events' values."""
    rows = table(spark, sf_dir, "events").where(which).select(F.concat(F.lit("f"), (F.col("user_id") % 500).cast("string")).alias("filecode"), "event_id", F.format_string("(%.2f, %.2f)", "value", F.col("value") + 1.25).alias("one"))
    rows = rows.groupBy("filecode").agg(F.sort_array(F.collect_list(F.struct("event_id", "one"))).alias("all"))
    return rows.select("filecode", F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["one"]), ", "), F.lit("]")).alias("artifacts"))


@query(f"""with known as (with {_lists_sql("event_type = 'click'")} select * from lists), newer as (with {_lists_sql("event_type = 'error' and user_id % 500 < 300")} select * from lists)
select * from known where filecode not in (select filecode from newer) union all select * from newer""")
def q_upsert_artifacts(spark, sf_dir):
    """Rows replaced or added by their key."""
    return upsert.merged(_lists(spark, sf_dir, "event_type = 'click'"), _lists(spark, sf_dir, "event_type = 'error' and user_id % 500 < 300"), ["filecode"])


_STIMS = """select user_id % 500 as subject, case when user_id % 3 = 0 then null else 'g' || (user_id % 3)::varchar end as grp, event_type as odor, max(event_id) as last, count(*) as n
from events where {} group by all"""


def _stims(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """(subject, grp, odor, last, n) of some events; every third subject's group is null."""
    rows = table(spark, sf_dir, "events").where(which).select((F.col("user_id") % 500).alias("subject"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string"))).alias("grp"), F.col("event_type").alias("odor"), "event_id")
    return rows.groupBy("subject", "grp", "odor").agg(F.max("event_id").alias("last"), F.count("*").alias("n"))


@query(f"""with known as ({_STIMS.format("event_id % 2 = 0")}), newer as (select *, last * 2 as twice from ({_STIMS.format("event_id % 3 = 0 and value < 60")}))
select k.*, null::bigint as twice from known k where not exists (select 1 from newer n where n.subject is not distinct from k.subject and n.grp is not distinct from k.grp and n.odor is not distinct from k.odor)
union all select * from newer""")
def q_upsert_sniffs(spark, sf_dir):
    """K6: rows replaced or added by several keys, nulls among them, with a column that only newer rows have."""
    newer = _stims(spark, sf_dir, "event_id % 3 = 0 and value < 60").withColumn("twice", F.col("last") * 2)
    return upsert.merged(_stims(spark, sf_dir, "event_id % 2 = 0"), newer, ["subject", "grp", "odor"])


@query(f"with sheet as ({_SHEET}) select filecode, row_number() over (partition by filecode order by k) - 1 as k, format('{{:.2f}}', v)::double as start_s, format('{{:.2f}}', v + 1.25)::double as stop_s from sheet where event_type = 'click'")
def q_parse_intervals(spark, sf_dir):
    """Interval lists read from text."""
    rows = _lists(spark, sf_dir, "event_type = 'click'").select("filecode", F.posexplode(S.parse_intervals(F.col("artifacts"))).alias("k", "pair"))
    return rows.select("filecode", F.col("k").cast("long").alias("k"), F.get("pair", F.lit(0)).alias("start_s"), F.get("pair", F.lit(1)).alias("stop_s"))


@query("""with names as (select s_suppkey % 6 as kind, s_suppkey % 2 as code, 'm' || s_suppkey::varchar as m from supplier)
select case kind when 0 then 'behav_' || code || '_' || m || '.csv' when 1 then 'x_1_' || m || '_' || m || '.csv' when 2 then 'x_9_' || m || '_' || m || '.csv' when 3 then 'a_b_' || m || '.csv' when 4 then m || '_' || m || '.csv' else m || '.csv' end as old_name,
       case kind when 0 then 'behav_' || code || '_' || m || '.csv' when 1 then 'behav_1_' || m || '.csv' when 2 then 'behav_0_' || m || '.csv' when 4 then 'behav_0_' || m || '.csv' end as new_name,
       case when kind = 0 then 'keep' when kind in (1, 2, 4) then 'rename' else 'delete' end as action, kind = 0 as scored from names""")
def q_rename_plan(spark, sf_dir):
    """What would become of scored files' names, made from suppliers' numbers."""
    m, kind = F.concat(F.lit("m"), F.col("s_suppkey").cast("string")), F.col("s_suppkey") % 6
    forms = [F.concat(F.lit("behav_"), (F.col("s_suppkey") % 2).cast("string"), F.lit("_"), m), F.concat(F.lit("x_1_"), m, F.lit("_"), m), F.concat(F.lit("x_9_"), m, F.lit("_"), m), F.concat(F.lit("a_b_"), m), F.concat(m, F.lit("_"), m), m]
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.get(F.array(*forms), kind.cast("int")), F.lit(".csv")).alias("old_name"))
    new, action = S.renamed(F.col("old_name"))
    return rows.select("old_name", new.alias("new_name"), action.alias("action"), F.col("old_name").startswith("behav_").alias("scored"))


@query(f"with {E_SQL} select rec, idx, round_even(x, 0) as even, trunc(x * 10) / 10.0::double as cut, greatest(0, least(idx - 5, count(*) over (partition by rec) - 1)) as inside, upper(behaviour[1]) || lower(behaviour[2:]) as label, behaviour[:-3] as short from rec_e")
def q_scalars(spark, sf_dir):
    """M1, M2, M6, T4, T5: rounding, cutting, clamping, names."""
    n = F.count("*").over(Window.partitionBy("rec"))
    rows = rec_e(spark, sf_dir)
    return rows.select("rec", "idx", S.half_even(F.col("x")).alias("even"), S.truncate(F.col("x"), 1).alias("cut"), S.clamp(F.col("idx") - 5, n).alias("inside"), S.capitalised(F.col("behaviour")).alias("label"), S.without_suffix(F.col("behaviour"), 2).alias("short"))


@query(f"with {E_SQL} select behaviour, count(*) as n from rec_e where behaviour not in ('click', 'view') group by behaviour")
def q_exclusion(spark, sf_dir):
    """states outside an exclusion list."""
    return rec_e(spark, sf_dir).where(~F.col("behaviour").isin("click", "view")).groupBy("behaviour").agg(F.count("*").alias("n"))


@query(f"with {_DIM} select grp, rec from dim where contains(batch, 'A') and grp in (0, 1)")
def q_group_filter(spark, sf_dir):
    """groups by part of a name, and by equality."""
    return subjects(spark, sf_dir).where(F.col("batch").contains("A") & F.col("grp").isin(0, 1)).select("grp", "rec")


@query(f"with {E_SQL} select rec, idx from rec_e where behaviour = 'error' qualify row_number() over (partition by rec order by idx) <= 2")
def q_first_two(spark, sf_dir):
    """The first two events of a kind."""
    e, events = _signups(spark, sf_dir, "error")
    return peth.first_events(events, 2).select("rec", "idx")


@query("""with lists as (select user_id, list(event_type order by event_id) as events, list(value order by event_id) as windows from events group by user_id)
select user_id, k, events[k + 1] as event, round(windows[k + 1], 6) as pre from (select *, unnest(range(len(events))) as k from lists)""")
def q_event_windows(spark, sf_dir):
    """Parallel lists zipped: each user's events with their windows."""
    each = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("all"))
    lists = each.select("user_id", F.transform("all", lambda x: x["event_type"]).alias("events"), F.transform("all", lambda x: x["value"]).alias("windows"))
    rows = lists.select("user_id", F.posexplode(F.arrays_zip("events", "windows")).alias("k", "z"))
    return rows.select("user_id", F.col("k").cast("long").alias("k"), F.col("z.events").alias("event"), F.round("z.windows", 6).alias("pre"))
