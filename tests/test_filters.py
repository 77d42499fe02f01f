"""Filters, peaks and spectra of recordings that many tasks share."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxtrace.operators import kernels as K

RATE = 10.0
RNG = np.random.default_rng(7)
TRACES = {"a": np.cumsum(RNG.normal(size=1234)), "b": RNG.normal(size=100), "c": RNG.normal(size=199) + 40, "d": RNG.normal(size=30), "e": RNG.normal(size=5)}


def frame(spark, traces):
    rows = [(rec, i, i / RATE, None if v is None or np.isnan(v) else float(v)) for rec, x in traces.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "rec string, idx long, time_s double, x double").repartition(5)


def by_rec(out):
    return {rec: part.sort_values("idx") for rec, part in out.toPandas().groupby("rec")}


@pytest.mark.parametrize("size", [22, 100, 4096])
def test_blocks_filter_as_the_whole_recording(spark, size):
    samples = frame(spark, TRACES)
    sections = {"low": K.butterworth(4, 1.0, RATE), "band": K.butterworth(3, (0.05, 0.5), RATE, "band"), "high": K.butterworth(2, 1.0, RATE, "high")}
    for name, out, pad in (("low", K.low_pass(samples, "x", rate=RATE, size=size), None), ("band", K.band_pass(samples, "x", 0.05, 0.5, RATE, size=size), 21), ("high", K.high_pass(samples, "x", 1.0, RATE, size=size), 9)):
        found = by_rec(out)
        for rec, x in TRACES.items():
            part = found[rec]
            assert part["idx"].tolist() == list(range(len(x)))
            if pad is not None and len(x) <= pad:
                assert part["filtered"].isna().all() and set(part["status"]) == {f"needs over {pad} samples"}
                continue
            whole = K.sos_filter(sections[name], x) if pad is None else K.zero_phase(sections[name], x, pad)
            assert set(part["status"]) == {"ok"}
            assert part["filtered"].to_numpy() == pytest.approx(whole, abs=1e-9)


def test_the_rate_is_found_by_recording_and_missing_samples_end_it(spark):
    broken = TRACES["a"].copy()
    broken[700] = np.nan
    samples = frame(spark, {"a": TRACES["a"], "b": TRACES["b"], "x": broken})
    found = by_rec(K.low_pass(samples, "x", size=100))
    assert found["a"]["filtered"].to_numpy() == pytest.approx(K.sos_filter(K.butterworth(4, 1.0, RATE), TRACES["a"]), abs=1e-9)
    assert found["x"]["filtered"].to_numpy()[:700] == pytest.approx(found["a"]["filtered"].to_numpy()[:700]) and found["x"]["filtered"][found["x"]["idx"] >= 700].isna().all()
    assert "1001" in found["b"]["status"].iloc[0] and found["b"]["filtered"].isna().all()
    twice = by_rec(K.band_pass(samples, "x", 0.05, 0.5, RATE, size=100))
    assert twice["x"]["filtered"].isna().all() and twice["a"]["filtered"].notna().all()


def test_a_rate_too_low_for_the_filter_is_a_status(spark):
    slow = frame(spark, {"a": TRACES["a"]}).withColumn("time_s", F.col("idx") * 1.0)
    found = K.low_pass(slow.unionByName(frame(spark, {"g": TRACES["a"]})), "x", size=100).groupBy("rec", "status").count().collect()
    assert {r.rec: r.status == "ok" for r in found} == {"a": False, "g": True}


def test_very_low_bands_stay_exact(spark):
    x = np.sin(np.arange(4000) / 7) + np.arange(4000) / 500
    out = by_rec(K.band_pass(frame(spark, {"a": x}), "x", 0.01, 0.5, RATE, size=300))["a"]
    assert out["filtered"].to_numpy() == pytest.approx(K.zero_phase(K.butterworth(3, (0.01, 0.5), RATE, "band"), x, 21), abs=1e-6)


@pytest.mark.parametrize("size", [50, 4096])
def test_peaks_in_chains_are_those_of_the_whole_recording(spark, size):
    rows, expected = [], set()
    for rec, n in ((1, 400), (2, 60), (3, 1)):
        at = np.sort(RNG.choice(4000, n, replace=False))
        heights = RNG.integers(0, 9, n).astype(float)
        rows += [(rec, int(i), float(h)) for i, h in zip(at, heights, strict=True)]
        expected |= {(rec, int(i)) for i in at[K.suppress_near(at, heights, 5)]}
    rows += [(4, i, float(i % 3)) for i in range(0, 600, 4)]  # one chain without a gap
    at = np.arange(0, 600, 4)
    expected |= {(4, int(i)) for i in at[K.suppress_near(at, (at % 3).astype(float), 5)]}
    maxima = spark.createDataFrame(rows, "rec long, idx long, height double").repartition(3)
    found = K.space_peaks(maxima, RATE, size=size).collect()
    assert {(r.rec, r.idx) for r in found} == expected and len(found) == len(expected)


def test_spectra_by_segment(spark):
    traces = {"long": RNG.normal(size=5000), "short": RNG.normal(size=700), "one": RNG.normal(size=1024), "gap": np.where(np.arange(2100) % 9, RNG.normal(size=2100), np.nan)}
    found = by_rec(K.spectrum(frame(spark, traces), "x", RATE).withColumnRenamed("bin", "idx"))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1024) / 1023)
    for rec, x in traces.items():
        x = np.nan_to_num(x)
        x = np.pad(x, (0, max(0, 1024 - len(x))))
        power = (np.abs(np.fft.rfft(x[: len(x) // 1024 * 1024].reshape(-1, 1024) * window, axis=1)) ** 2).mean(axis=0) / (RATE * (window**2).sum())
        power[1:-1] *= 2
        assert found[rec]["power"].to_numpy() == pytest.approx(power)


def test_no_group_is_a_recording(spark):
    samples = frame(spark, {"a": TRACES["b"]})
    for out in (K.low_pass(samples, "x", rate=RATE), K.band_pass(samples, "x", 0.05, 0.5, RATE), K.high_pass(samples, "x", 1.0, RATE)):
        text = out._jdf.queryExecution().executedPlan().toString()
        groups = [x for x in text.splitlines() if "FlatMapGroups" in x]
        assert groups and all("scan(" in x for x in groups)  # over one row a block
    text = K.space_peaks(samples.select("rec", "idx", F.col("x").alias("height")), RATE)._jdf.queryExecution().executedPlan().toString()
    assert all("_group" in x for x in text.splitlines() if "FlatMapGroups" in x)
    assert "FlatMapGroups" not in K.spectrum(samples, "x", RATE)._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    empty = frame(spark, {"a": TRACES["b"]}).limit(0)
    assert K.low_pass(empty, "x", rate=RATE).count() == 0 == K.spectrum(empty, "x", RATE).count()
    assert K.space_peaks(empty.select("rec", "idx", F.col("x").alias("height")), RATE).count() == 0
    assert isinstance(K.band_pass(empty, "x", 0.05, 0.5, RATE).toPandas(), pd.DataFrame)
