"""Recursive filters, peak suppression and spectra: NumPy kernels on blocks of a recording.

Filters are cascades of second-order sections, and so linear in their samples and the state in
which a block begins.  A first pass gives for each block the state in which it would end had it
begun at rest; a recording's table of these, one row a block, is scanned for the true states; then
each block is filtered from its own.  A filter forward and backward needs no pass more: what its
second way adds is linear too.  No task holds a recording's samples.

A filter's result has a status beside it, ok or why a recording can't be filtered; the others are
filtered all the same.  Peaks and spectra are defined for all samples, missing ones too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .guards import require_columns


def _poles(order: int) -> list[complex]:
    """Left half-plane poles of the normalised Butterworth prototype."""
    return [complex(-math.sin(math.pi * (2 * k + 1) / (2 * order)), math.cos(math.pi * (2 * k + 1) / (2 * order))) for k in range(order)]


def butterworth(order: int, cut: float | tuple[float, float], rate: float, kind: str = "low") -> np.ndarray:
    """Sections (b0, b1, b2, 1, a1, a2) by prewarping and the bilinear transform; kind: low, high or band."""
    warp = lambda f: 2 * rate * math.tan(math.pi * f / rate)
    prototype = _poles(order)
    if kind == "low":
        w = warp(cut)
        poles, zeros = [p * w for p in prototype], [-1.0] * order
        unit = 1.0
    elif kind == "high":
        w = warp(cut)
        poles, zeros = [w / p for p in prototype], [1.0] * order
        unit = -1.0
    elif kind == "band":
        lo, hi = warp(cut[0]), warp(cut[1])
        half, centre = (hi - lo) / 2, lo * hi
        poles = [p * half + s * np.sqrt(complex((p * half) ** 2 - centre)) for p in prototype for s in (1, -1)]
        zeros = [1.0, -1.0] * order
        unit = np.exp(2j * math.atan(math.sqrt(centre) / (2 * rate)))
    else:
        raise ValueError("kind must be low, high or band")
    digital = [(2 * rate + p) / (2 * rate - p) for p in poles]
    upper = sorted((p for p in digital if p.imag > 1e-12), key=lambda p: (abs(p), p.imag))
    real = sorted(p.real for p in digital if abs(p.imag) <= 1e-12)
    pairs = [(p, p.conjugate()) for p in upper] + [(real[i], real[i + 1] if i + 1 < len(real) else 0.0) for i in range(0, len(real), 2)]
    zeros = sorted(zeros) if kind != "band" else zeros
    sections = []
    for i, (p, q) in enumerate(pairs):
        z = zeros[2 * i : 2 * i + 2]
        b = np.real(np.poly(z)) if z else np.array([1.0])
        a = np.real(np.array([1, -(p + q), p * q]))
        if len(z) == 1:
            b = np.append(b, 0.0)
        gain = abs(np.polyval(a, unit) / np.polyval(b, unit))
        sections.append([*(b * gain), *a])
    return np.array(sections)


#: Samples that a filter handles by one matrix product.
BLOCK = 256


def _section(x: np.ndarray, section: list[float], state: tuple[float, float]) -> np.ndarray:
    """One second-order section by blocks: the answer to a block's own samples, all blocks at once, and to the state it begins in."""
    b0, b1, b2, _, a1, a2 = section
    step, enter = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    powers = np.array(powers)
    impulse = np.concatenate([[b0], (powers[: BLOCK - 1] @ enter)[:, 0]])
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
    own = np.where(lag >= 0, impulse[lag], 0.0)
    into = powers[BLOCK - 1 :: -1][:BLOCK] @ enter
    blocks = np.pad(x, (0, -len(x) % BLOCK)).reshape(-1, BLOCK)
    states, z, gains = np.empty((len(blocks), 2)), np.array(state), blocks @ into
    for k, gain in enumerate(gains):
        states[k] = z
        z = powers[BLOCK] @ z + gain
    return (blocks @ own.T + states @ powers[:BLOCK, 0].T).ravel()[: len(x)]


def sos_filter(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Direct form II transposed, from ``state`` or rest; from the first sample on that is no finite number, all is NaN."""
    x = np.asarray(x, float)
    broken = np.flatnonzero(~np.isfinite(x))
    y = x[: broken[0]] if len(broken) else x
    for k, section in enumerate(np.asarray(sections).tolist()):
        y = _section(y, section, (0.0, 0.0) if state is None else tuple(state[k]))
    return np.concatenate([y, np.full(len(x) - len(y), np.nan)])


def step_state(sections: np.ndarray) -> np.ndarray:
    """The states in which a constant input of 1 gives a constant output."""
    scale, states = 1.0, []
    for b0, b1, b2, _, a1, a2 in np.asarray(sections).tolist():
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 - a2 * gain
        states.append((scale * (b1 - a1 * gain + z2), scale * z2))
        scale *= gain
    return np.array(states)


def zero_phase(sections: np.ndarray, x: np.ndarray, pad: int) -> np.ndarray:
    """Forward and backward, the ends extended oddly by ``pad`` samples; too short an input is an error."""
    x = np.asarray(x, float)
    if len(x) <= pad:
        raise ValueError(f"needs over {pad} samples")
    padded = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    start = step_state(sections)
    y = sos_filter(sections, padded, start * padded[0])
    y = sos_filter(sections, y[::-1], start * y[-1])[::-1]
    return y[pad : len(y) - pad]


def suppress_near(positions: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Which peaks stay when higher ones remove all nearer than ``distance``; of equals the later goes first.

    positions: in ascending order; a peak looks only at those within its distance.
    """
    stays = np.ones(len(positions), bool)
    first = np.searchsorted(positions, positions - distance, "right")
    last = np.searchsorted(positions, positions + distance, "left")
    for k in np.argsort(heights, kind="stable")[::-1]:
        if stays[k]:
            stays[first[k] : k] = False
            stays[k + 1 : last[k]] = False
    return stays


@lru_cache(maxsize=64)
def _steps(section: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a section: the powers of its state's step, the answers to a block's own samples, and what each adds to the state."""
    b0, b1, b2, _, a1, a2 = section
    step, enter = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    powers = np.array(powers)
    impulse = np.concatenate([[b0], (powers[: BLOCK - 1] @ enter)[:, 0]])
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
    return powers, np.where(lag >= 0, impulse[lag], 0.0), powers[:BLOCK] @ enter


def run_blocks(sections: np.ndarray, x: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters the rows of x side by side, each from its state of two numbers a section; the outputs and the states at the end."""
    y, ends = x, np.empty_like(states)
    for k, section in enumerate(map(tuple, np.asarray(sections).tolist())):
        powers, own, adds = _steps(section)
        out, z = np.empty_like(y), states[:, 2 * k : 2 * k + 2]
        for at in range(0, y.shape[1], BLOCK):
            part = y[:, at : at + BLOCK]
            n = part.shape[1]
            out[:, at : at + n] = part @ own[:n, :n].T + z @ powers[:n, 0].T
            z = z @ powers[n].T + part @ adds[n - 1 :: -1][:n]
        y, ends[:, 2 * k : 2 * k + 2] = out, z
    return y, ends


@lru_cache(maxsize=256)
def _answers(sections: tuple[tuple[float, ...], ...], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a state at the start does to a block of n samples of zero, row by row for unit states: the state
    at its end, the output's last sample, and the state at its start when the output is filtered backward."""
    sos, size = np.array(sections), 2 * len(sections)
    y, ends = run_blocks(sos, np.zeros((size, n)), np.eye(size))
    _, back = run_blocks(sos, y[:, ::-1], np.zeros((size, size)))
    return ends, y[:, -1], back


_PACKED = "rec {rec}, block long, first long, n_blocks long, rate double, status string, x array<double>"
_PASSED = "rec {rec}, block long, n long, broken boolean, head double, tail double, ends array<double>, back array<double>, rate double"
_STATES = "rec {rec}, block long, before boolean, at_all boolean, forward array<double>, backward array<double>"


def _rec_type(frame: DataFrame) -> str:
    return frame.schema["rec"].dataType.simpleString()


def _packed(samples: DataFrame, channel: str, recordings: DataFrame, size: int) -> DataFrame:
    """A row for each block: its samples in an array; the last block takes what is left, less than two blocks.

    recordings: (rec, n, rate, status).
    """
    rows = samples.select("rec", "idx", F.col(channel).cast("double").alias("x")).join(recordings, "rec")
    last = F.greatest(F.floor(F.col("n") / size), F.lit(1)) - 1
    rows = rows.withColumn("block", F.least(blocks.block_of("idx", size), last).cast("long"))
    rows = rows.groupBy("rec", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("_xs"), F.first("n").alias("n"), F.first("rate").alias("rate"), F.first("status").alias("status"))
    return rows.select("rec", "block", F.col("_xs")[0]["idx"].alias("first"), (F.greatest(F.floor(F.col("n") / size), F.lit(1))).cast("long").alias("n_blocks"), "rate", "status", F.transform("_xs", lambda s: s["x"]).alias("x"))


def _filtered(samples: DataFrame, channel: str, design: Callable[[float], np.ndarray], recordings: DataFrame, pad: int | None, size: int) -> DataFrame:
    """(rec, idx, filtered, status).  design: sections for a rate; pad: None for a filter forward from rest, else
    the samples by which both ends are extended oddly for one forward and backward."""
    rec = _rec_type(samples)
    parts = _packed(samples, channel, recordings, size)

    def extended(row: dict) -> np.ndarray:
        x = np.array([np.nan if v is None else v for v in row["x"]] if None in row["x"] else row["x"], float)
        if pad is not None:
            start = 2 * x[0] - x[pad:0:-1] if row["block"] == 0 else x[:0]
            stop = 2 * x[-1] - x[-2 : -pad - 2 : -1] if row["block"] == row["n_blocks"] - 1 else x[:0]
            x = np.concatenate([start, x, stop])
        return x

    def alike(rows: list[dict]) -> Iterator[tuple[list[dict], np.ndarray, np.ndarray]]:
        """Rows of one length and rate, a few at once: the rows, their samples, and the sections."""
        xs = [extended(r) for r in rows]
        groups: dict[tuple[int, float], list[int]] = {}
        for i, r in enumerate(rows):
            groups.setdefault((len(xs[i]), r["rate"]), []).append(i)
        for (_, rate), members in groups.items():
            yield [rows[i] for i in members], np.stack([xs[i] for i in members]), np.asarray(design(rate))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [r for r in batch.to_pylist() if r["status"] == "ok"]
            out = []
            for rows, x, sections in alike(good):
                fine = np.isfinite(x).all(axis=1)
                clean = np.where(fine[:, None], x, 0.0)
                rest = np.zeros((len(x), 2 * len(sections)))
                y, ends = run_blocks(sections, clean, rest)
                back = run_blocks(sections, y[:, ::-1], rest)[1] if pad is not None else rest
                out += [
                    {"rec": r["rec"], "block": r["block"], "n": x.shape[1], "broken": not fine[i], "head": float(clean[i, 0]), "tail": float(y[i, -1]), "ends": ends[i].tolist(), "back": back[i].tolist(), "rate": r["rate"]}
                    for i, r in enumerate(rows)
                ]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(batch.schema.field("rec")), ("block", pa.int64()), ("n", pa.int64()), ("broken", pa.bool_()), ("head", pa.float64()), ("tail", pa.float64()), ("ends", pa.list_(pa.float64())), ("back", pa.list_(pa.float64())), ("rate", pa.float64())]))

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        """The true states of a recording's blocks, from one row a block."""
        frame = frame.sort_values("block")
        sections = np.asarray(design(float(frame["rate"].iloc[0])))
        key = tuple(map(tuple, sections.tolist()))
        steady = step_state(sections).ravel()
        n, ends, back = frame["n"].tolist(), np.stack(frame["ends"].to_list()), np.stack(frame["back"].to_list())
        z = steady * frame["head"].iloc[0] if pad is not None else np.zeros(2 * len(sections))
        forward, backward = [], [np.zeros(2 * len(sections))] * len(frame)
        for k, size_of in enumerate(n):
            forward.append(z)
            z = ends[k] + z @ _answers(key, size_of)[0]
        if pad is not None:
            z = steady * (frame["tail"].iloc[-1] + forward[-1] @ _answers(key, n[-1])[1])
            for k in range(len(n) - 1, -1, -1):
                backward[k] = z
                step, _, own = _answers(key, n[k])
                z = back[k] + forward[k] @ own + z @ step
        broken = frame["broken"].to_numpy(bool)
        return pd.DataFrame({"rec": frame["rec"], "block": frame["block"], "before": np.concatenate([[False], np.cumsum(broken)[:-1] > 0]), "at_all": broken.any(), "forward": [v.tolist() for v in forward], "backward": [v.tolist() for v in backward]})

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[tuple[dict, np.ndarray | None]] = []
            everything = batch.to_pylist()
            for rows, x, sections in alike([r for r in everything if r["status"] == "ok"]):
                clean = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
                y, _ = run_blocks(sections, clean, np.array([r["forward"] for r in rows]))
                if pad is not None:
                    y = run_blocks(sections, y[:, ::-1], np.array([r["backward"] for r in rows]))[0][:, ::-1]
                for i, r in enumerate(rows):
                    own, bad = y[i], np.flatnonzero(~np.isfinite(x[i]))
                    if (r["at_all"] if pad is not None else r["before"]) or (len(bad) and pad is not None):
                        own = np.full_like(own, np.nan)
                    elif len(bad):
                        own = np.concatenate([own[: bad[0]], np.full(len(own) - bad[0], np.nan)])
                    begin = pad if pad is not None and r["block"] == 0 else 0
                    done.append((r, own[begin : begin + len(r["x"])]))
            done += [(r, None) for r in everything if r["status"] != "ok"]
            lengths = [len(r["x"]) for r, _ in done]
            values = np.concatenate([np.full(n, np.nan) if y is None else y for (_, y), n in zip(done, lengths, strict=True)]) if done else np.zeros(0)
            numbers = np.concatenate([r["first"] + np.arange(n) for (r, _), n in zip(done, lengths, strict=True)]) if done else np.zeros(0, np.int64)
            at = pa.array(np.repeat(np.arange(len(done)), lengths))
            recs, states = pa.array([r["rec"] for r, _ in done], batch.schema.field("rec").type), pa.array([r["status"] for r, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([recs.take(at), pa.array(numbers), pa.array(values, mask=np.isnan(values)), states.take(at)], ["rec", "idx", "filtered", "status"])

    states = parts.mapInArrow(first_pass, _PASSED.format(rec=rec)).groupBy("rec").applyInPandas(scan, _STATES.format(rec=rec))
    rows = parts.join(states, ["rec", "block"], "left")
    return rows.mapInArrow(last_pass, f"rec {rec}, idx long, filtered double, status string")


def low_pass(samples: DataFrame, channel: str, order: int = 4, cut: float = 1.0, rate: float | None = None, size: int = blocks.BLOCK) -> DataFrame:
    """(rec, idx, filtered, status): causal low-pass from rest.  Without a rate it is taken from
    samples 0 and 1000, so shorter recordings get a status and nulls, as do those whose rate is
    too low for the cut-off.  Numbers have no gaps."""
    require_columns(samples, ["rec", "idx", channel, *(["time_s"] if rate is None else [])])
    if rate is None:
        at = lambda i: F.max(F.when(F.col("idx") == i, F.col("time_s")))
        found = samples.groupBy("rec").agg(F.count("*").alias("n"), (F.lit(1000.0) / F.nullif(at(1000) - at(0), F.lit(0.0))).alias("rate"))
        why = F.when(F.col("n") < 1001, "needs 1001 samples to find the rate").when(F.col("rate").isNull() | ~(F.col("rate") > 2 * cut), "the cut-off must lie below half the rate")
        found = found.withColumn("status", F.coalesce(why, F.lit("ok")))
    else:
        found = samples.groupBy("rec").agg(F.count("*").alias("n")).withColumn("rate", F.lit(float(rate))).withColumn("status", F.lit("ok"))
    return _filtered(samples, channel, lambda r: butterworth(order, cut, r), found, None, size)


def _long_enough(samples: DataFrame, rate: float, pad: int) -> DataFrame:
    sizes = require_columns(samples, ["rec", "idx"]).groupBy("rec").agg(F.count("*").alias("n")).withColumn("rate", F.lit(float(rate)))
    return sizes.withColumn("status", F.when(F.col("n") <= pad, f"needs over {pad} samples").otherwise("ok"))


def band_pass(samples: DataFrame, channel: str, low: float, high: float, rate: float, order: int = 3, size: int = blocks.BLOCK) -> DataFrame:
    """(rec, idx, filtered, status): zero-phase band-pass, ends extended by 3 * (2 * order + 1) samples.  Numbers have no gaps."""
    sections, pad = butterworth(order, (low, high), rate, "band"), 3 * (2 * order + 1)
    return _filtered(samples, channel, lambda _: sections, _long_enough(samples, rate, pad), pad, max(size, pad + 1))


def high_pass(samples: DataFrame, channel: str, cut: float, rate: float, order: int = 2, size: int = blocks.BLOCK) -> DataFrame:
    """(rec, idx, filtered, status): zero-phase high-pass; a cut-off at or above half the rate is an error.  Numbers have no gaps."""
    if not 0 < cut < rate / 2:
        raise ValueError("the cut-off must lie between 0 and half the rate")
    sections, pad = butterworth(order, cut, rate, "high"), 3 * (order + 1)
    return _filtered(samples, channel, lambda _: sections, _long_enough(samples, rate, pad), pad, max(size, pad + 1))


def space_peaks(maxima: DataFrame, rate: float, seconds: float = 0.5, size: int = 16 * blocks.BLOCK) -> DataFrame:
    """(rec, idx, height): peaks, the highest first, at least ceil(seconds * rate) samples apart.

    Peaks further apart than that never meet, so a recording's fall into chains, and the
    chains that begin in one block of ``size`` sample numbers make a group.  Only a
    chain without such a gap, of one peak in every ceil(seconds * rate) samples throughout, is as
    long as its recording.  Of equal peaks at one place one stays.
    """
    distance = math.ceil(seconds * rate)
    rows = blocks.Carried(blocks.deal(maxima.select("rec", "idx", "height"), size=size)).lag("_before", F.col("idx")).frame()
    starts = F.col("_before").isNull() | (F.col("idx") - F.col("_before") >= distance)
    chained = blocks.Carried(rows).last("_chain", F.when(starts, F.col("idx"))).frame()

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx", kind="stable")[["rec", "idx", "height"]]
        return frame[suppress_near(frame["idx"].to_numpy(), frame["height"].to_numpy(float), distance)]

    groups = chained.withColumn("_group", blocks.block_of("_chain", size)).groupBy("rec", "_group")
    return groups.applyInPandas(kernel, f"rec {_rec_type(maxima)}, idx long, height double")


def spectrum(samples: DataFrame, channel: str, rate: float, size: int = 1024) -> DataFrame:
    """(rec, bin, freq, power): the mean periodogram of Hann-windowed segments without overlap.

    One-sided density; missing samples count as 0; a recording shorter than a segment is padded with
    zeros, and what is left after the last whole segment doesn't count.  Numbers have no gaps.  A
    segment is the largest group; a task adds up its segments by recording before they are shuffled.
    """
    rec = _rec_type(samples)
    parts = samples.select("rec", "idx", F.coalesce(F.nanvl(F.col(channel).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("x")).groupBy("rec", blocks.block_of("idx", size).alias("block"))
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("xs")).where((F.col("block") == 0) | (F.size("xs") == size)).select("rec", F.transform("xs", lambda s: s["x"]).alias("x"))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.pad(np.array(v, float), (0, size - len(v))) for v in batch.column(1).to_pylist()]) * window
            power = np.abs(np.fft.rfft(x, axis=1)) ** 2 / (rate * (window**2).sum())
            power[:, 1:-1] *= 2
            codes = batch.column(0).dictionary_encode()
            at = codes.indices.to_numpy()
            sums, counts = np.zeros((len(codes.dictionary), power.shape[1])), np.bincount(at, minlength=len(codes.dictionary))
            np.add.at(sums, at, power)
            yield pa.RecordBatch.from_arrays([codes.dictionary, pa.array(counts.astype(np.int64)), pa.array(list(sums), pa.list_(pa.float64()))], ["rec", "n", "sums"])

    sums = parts.mapInArrow(run, f"rec {rec}, n long, sums array<double>").select("rec", "n", F.posexplode("sums").alias("bin", "power"))
    rows = sums.groupBy("rec", F.col("bin").cast("long").alias("bin")).agg((F.sum("power") / F.sum("n")).alias("power"))
    return rows.select("rec", "bin", (F.col("bin") * rate / size).alias("freq"), "power")
