import numpy as np
import pytest

from fluxtrace.operators import kernels as K

RATE = 10.0


def gain(sections, f, rate=RATE):
    z = np.exp(-2j * np.pi * f / rate)
    return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sections]))


def test_low_pass_response():
    s = K.butterworth(4, 1.0, RATE)
    assert gain(s, 0) == pytest.approx(1) and gain(s, 1.0) == pytest.approx(2**-0.5) and gain(s, 4.0) < 1e-3


def test_band_and_high_pass_response():
    band = K.butterworth(3, (0.05, 0.5), RATE, "band")
    assert gain(band, 0.05) == pytest.approx(2**-0.5) and gain(band, 0.5) == pytest.approx(2**-0.5) and gain(band, 0) < 1e-9
    high = K.butterworth(2, 1.0, RATE, "high")
    assert gain(high, 5.0) == pytest.approx(1) and gain(high, 1.0) == pytest.approx(2**-0.5) and gain(high, 0) < 1e-9


def test_very_low_band_stays_finite():
    out = K.zero_phase(K.butterworth(3, (1e-4, 0.5), RATE, "band"), np.sin(np.arange(4000) / 7), 21)
    assert np.isfinite(out).all()


def test_filter_is_linear_and_reaches_a_constant():
    s = K.butterworth(4, 1.0, RATE)
    a, b = np.random.default_rng(1).normal(size=(2, 300))
    assert K.sos_filter(s, 2 * a - b) == pytest.approx(2 * K.sos_filter(s, a) - K.sos_filter(s, b))
    assert K.sos_filter(s, np.ones(500))[-1] == pytest.approx(1)
    assert np.isnan(K.sos_filter(s, np.array([1.0, np.nan, 1.0]))[1:]).all()


def test_zero_phase_keeps_place_and_constants():
    s = K.butterworth(4, 1.0, RATE)
    assert K.zero_phase(s, np.full(200, 3.0), 27) == pytest.approx(np.full(200, 3.0))
    x = np.exp(-(((np.arange(401) - 200) / 12) ** 2))
    assert np.argmax(K.zero_phase(s, x, 27)) == 200
    with pytest.raises(ValueError):
        K.zero_phase(s, np.ones(10), 27)


def test_peaks_keep_their_distance():
    at, heights = np.array([0, 3, 5, 20, 24]), np.array([1.0, 5.0, 4.0, 2.0, 2.0])
    stays = at[K.suppress_near(at, heights, 5)]
    assert stays.tolist() == [3, 24]


def test_short_recordings_get_a_status(spark):
    rows = spark.createDataFrame([(0, i, i / 10, 1.0) for i in range(5)], "rec long, idx long, time_s double, x double")
    out = K.low_pass(rows, "x").collect()
    assert all(r.filtered is None and "1001" in r.status for r in out)


def test_spectrum_finds_a_sine(spark):
    rows = spark.createDataFrame([(0, i, float(np.sin(2 * np.pi * 2.5 * i / 10))) for i in range(2048)], "rec long, idx long, x double")
    top = max(K.spectrum(rows, "x", RATE).collect(), key=lambda r: r.power)
    assert top.freq == pytest.approx(2.5)


def plain_filter(sections, x):
    y = list(map(float, x))
    for b0, b1, b2, _, a1, a2 in sections.tolist():
        z1 = z2 = 0.0
        for i, v in enumerate(y):
            w = b0 * v + z1
            z1, z2 = b1 * v - a1 * w + z2, b2 * v - a2 * w
            y[i] = w
    return y


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1500])
def test_blocks_give_what_a_step_for_each_sample_gives(n):
    x = np.random.default_rng(n).normal(size=n)
    for s in (K.butterworth(4, 1.0, RATE), K.butterworth(3, (0.05, 0.5), RATE, "band"), K.butterworth(2, 1.0, RATE, "high")):
        assert K.sos_filter(s, x) == pytest.approx(plain_filter(s, x), abs=1e-9)


def test_many_peaks_match_a_plain_search():
    rng = np.random.default_rng(4)
    at, heights = np.sort(rng.choice(2000, 500, replace=False)), rng.integers(0, 20, 500).astype(float)
    left, stays = set(range(500)), set()
    for k in sorted(range(500), key=lambda k: (heights[k], k), reverse=True):
        if k in left:
            stays.add(k)
            left -= {j for j in left if abs(at[j] - at[k]) < 7}
    assert np.flatnonzero(K.suppress_near(at, heights, 7)).tolist() == sorted(stays)
