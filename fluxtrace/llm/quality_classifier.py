"""Quality classifier by co-training on two views of a document.

One view is the text's content (its characters and the shape of its words), the other
the document's metadata (source, language, length).  Each has a logistic regression,
fitted on a bounded sample of labelled documents.  In each round a distributed pass has
both views score all unlabelled documents; those that a view is surest of for its own
distribution, and has not handed over before, go with its label to the other view, whose
fit sees a bounded sample of them.  A further logistic regression calibrates and combines the two views' log-odds,
taken for each labelled document from fits without its fold.  All documents are then scored in one pass.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampled import least_by_hash
from .textbuf import slices, utf8_buffer
from .workspace import Workspace

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class CoTrainingParams:
    """labelled: labelled documents that the fit sees at most, those of least id hash.  handed: share
    of the unlabelled documents not yet handed over that each view hands over in a round, split between
    good and bad as the labels are.  pool: handed documents that a
    view's fit sees at most, an equal part from each round, those of least row hash.  folds: of the
    calibration.  threshold: least probability of good quality to be kept, below a half so that doubt
    keeps a document."""

    labelled: int = 4000
    pool: int = 2000
    rounds: int = 3
    handed: float = 0.05
    folds: int = 5
    threshold: float = 0.4
    buckets: int = 512


_SHAPES = 12
_META = 130
_STEPS = 1000


#: Bytes of a text that are counted at once.
_CHUNK = 1 << 16
# Groups of characters that the text view counts by bytes, or by words.
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_BY_BYTE = (_UPPER, _DIGITS, bytes(range(128, 256)), b"\n")
_BY_WORD = (b"!", b"|", b"#*$%&<>", b".,;:?", b"@/_=")
_MEMBERS = np.array([[b in group for group in (*_BY_BYTE, *_BY_WORD)] for b in range(256)], np.int64)
_SPACES = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_PRINTS = (np.arange(256) * 31 + np.where(_SPACES, 0, 7)).astype(np.uint16)


@cache
def _pair_buckets(buckets: int) -> np.ndarray:
    """The bucket of each pair of bytes."""
    first, second = np.divmod(np.arange(1 << 16, dtype=np.int64), 256)
    return (((first * 0x9E3779B1 + second * 0x85EBCA77) >> 7) % buckets).astype(np.uint16)


def text_view(column: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For slices of rows: the first row's number and a row of features for each text.

    Shares of kinds of bytes and of words, and square roots of the shares of hashed byte pairs.
    A text's features do not depend on the rows around it.
    """
    data, bounds = utf8_buffer(column)
    table = _pair_buckets(buckets)
    for lo, hi in slices(bounds):
        part = data[bounds[lo] : bounds[hi]]
        cut = bounds[lo : hi + 1] - bounds[lo]
        sizes, rows = np.diff(cut), hi - lo
        kinds, grams = np.zeros((rows, 256), np.int64), np.zeros((rows, buckets), np.int64)
        for i, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False)):
            for at in range(a, b, _CHUNK):
                some = part[at : min(at + _CHUNK + 1, b)]
                kinds[i] += np.bincount(some[:_CHUNK], minlength=256)
                grams[i] += np.bincount(table[(some[:-1].astype(np.uint16) << 8) | some[1:]], minlength=buckets)
        space = _SPACES[part]
        starts = ~space
        if len(part):
            first = np.zeros(len(part), bool)
            first[cut[:-1][sizes > 0]] = True
            starts[1:] &= space[:-1] | first[1:]
        starts = np.flatnonzero(starts)
        owner = np.searchsorted(cut, starts, "right") - 1
        n, words = np.maximum(sizes, 1), np.maximum(np.bincount(owner, minlength=rows), 1)
        # Copies of one word in a row show as equal sums of bytes.
        echo = np.zeros(rows)
        if len(starts):
            prints = np.add.reduceat(_PRINTS[part], starts, dtype=np.int64)
            twice = (prints[1:] == prints[:-1]) & (owner[1:] == owner[:-1])
            echo = np.bincount(owner[1:][twice], minlength=rows) / words
        counts = kinds @ _MEMBERS
        shapes = np.column_stack([counts[:, : len(_BY_BYTE)] / n[:, None], np.minimum(3, counts[:, len(_BY_BYTE) :] / words[:, None]), np.minimum(3, n / words / 10), np.log1p(sizes) / 10, echo])
        yield lo, np.column_stack([shapes, np.sqrt(grams / n[:, None])]).astype(np.float32)


def metadata_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, each with a place of its own for null, and the length."""
    out = np.zeros((len(source), _META), np.float32)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, 0 if s is None else 1 + xxhash.xxh64_intdigest(str(s)) % 63] = 1
        out[i, 64 if g is None else 65 + xxhash.xxh64_intdigest(str(g)) % 63] = 1
        out[i, 128] = np.log1p(max(0, n or 0)) / 10
        out[i, 129] = n is None
    return out


def _top_eigenvalue(z: np.ndarray, steps: int = 30) -> float:
    """About the largest eigenvalue of the mean outer product of rows, by power iteration."""
    v, size = z.std(axis=0) + np.float32(1e-3), 0.0
    for _ in range(steps):
        v = z.T @ (z @ (v / np.linalg.norm(v))) / len(z)
        size = float(np.linalg.norm(v))
        if not size:
            break
    return size


@dataclass
class Logistic:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 300) -> Logistic:
        """Nesterov gradient steps on the mean log-loss with a ridge; a single class gives its share as constant odds."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = ((x - mean) / scale).astype(np.float32)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        w, b = np.zeros(z.shape[1], np.float32), float(np.log(share / (1 - share)))
        if 0 < y.mean() < 1:
            step = 4.0 / max(1.1 * _top_eigenvalue(z), 1.0)
            last_w, last_b = w.copy(), b
            for k in range(steps):
                look = k / (k + 3)
                aw, ab = w + look * (w - last_w), b + look * (b - last_b)
                error = 1 / (1 + np.exp(-np.clip(z @ aw + ab, -30, 30))) - y
                last_w, last_b = w, b
                w = aw - step * (z.T @ error / len(z) + ridge * aw).astype(np.float32)
                b = ab - step * float(error.mean())
        return cls(mean, scale, w, b)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


@dataclass(frozen=True)
class HandOver:
    """What a view gave in a round: of so many unlabelled documents that it had not handed over before,
    those called good and bad, and those of them that the other view's fit saw."""

    round: int
    giver: str
    unlabelled: int
    good: int
    bad: int
    seen: int


@dataclass
class QualityModel:
    """Both views' regressions, the regression that calibrates and combines them, and the exchange of their fit."""

    text: Logistic
    meta: Logistic
    both: Logistic
    exchange: tuple[HandOver, ...] = ()

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by text, by metadata, combined."""
        a, b = np.clip(self.text.odds(text), -20, 20), np.clip(self.meta.odds(meta), -20, 20)
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (a, b, self.both.odds(np.column_stack([a, b]))))


def _features(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Both views of a bounded table (key, text, source, lang, n_chars), in the order of key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = metadata_view(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            for lo, rows in text_view(batch.column(1), buckets):
                whole = np.column_stack([rows, meta[lo : lo + len(rows)]]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + len(rows)], pa.array([r.tobytes() for r in whole], pa.binary())], ["key", "features"])

    rows = sorted(docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, features binary").collect(), key=lambda r: (str(r.key), r.features))
    table = np.stack([np.frombuffer(r.features, np.float32) for r in rows]) if rows else np.zeros((0, _SHAPES + buckets + _META), np.float32)
    return table[:, :-_META], table[:, -_META:], [r.key for r in rows]


def _steps(odds: np.ndarray) -> np.ndarray:
    """Log-odds in whole steps, so that a bounded table counts them."""
    return np.clip(np.floor(odds * _STEPS), -20 * _STEPS, 20 * _STEPS).astype(np.int32)


#: The views' regressions of a round, and for each view the steps up to which and from which it handed documents over.
Round = tuple[dict[str, Logistic], dict[str, tuple[int, int]]]


def _scored(docs: DataFrame, models: dict[str, Logistic], past: list[Round], buckets: int) -> DataFrame:
    """(row, doc_id, text, meta) of all rows of docs: each view's log-odds in steps, null if it handed the row over in a past round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = metadata_view(*(batch.column(i).to_pylist() for i in (3, 4, 5)))
            for lo, text in text_view(batch.column(2), buckets):
                found = []
                for view, x in (("text", text), ("meta", meta[lo : lo + len(text)])):
                    gone = np.zeros(len(x), bool)
                    for old, bars in past:
                        steps, (low, high) = _steps(old[view].odds(x)), bars[view]
                        gone |= (steps <= low) | (steps >= high)
                    found.append(pa.array(_steps(models[view].odds(x)), pa.int32(), mask=gone))
                yield pa.RecordBatch.from_arrays([batch.column(i)[lo : lo + len(text)] for i in (0, 1)] + found, ["row", "doc_id", "text", "meta"])

    return docs.mapInArrow(run, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text int, meta int")


def _bars(counts: Counter, good: float, p: CoTrainingParams) -> tuple[int, int]:
    """Steps up to which, and from which, a view hands documents over: the ends of its own distribution.

    An end has at least its share (and one document), ties included, and never reaches the median, so a
    view that tells nothing apart hands nothing over.
    """
    total, bars = sum(counts.values()), []
    steps, seen = sorted(counts), 0
    for step in steps:
        seen += counts[step]
        if 2 * seen >= total:
            middle = step
            break
    for ends, share, outer in ((steps, 1 - good, -20 * _STEPS - 1), (steps[::-1], good, 20 * _STEPS + 1)):
        bar, seen = outer, 0
        for step in ends:
            if seen >= max(1, p.handed * share * total) or step == middle:
                break
            bar, seen = step, seen + counts[step]
        bars.append(bar)
    return bars[0], bars[1]


def train(docs: DataFrame, labels: DataFrame, params: CoTrainingParams | None = None) -> QualityModel:
    """Fits on documents with a quality of 0 or 1 in labels, and exchanges labels of all other documents.

    Without a labelled document every probability is a half.
    Other labels and null ids in labels are passed over; documents with such a label or id are
    unlabelled.  All labelled rows of the sample are fitted on, and calibrate by folds.
    """
    p = params or CoTrainingParams()
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(least_by_hash(known.join(ids, "doc_id", "left_semi"), "doc_id", p.labelled))
    columns = ["text", "source", "lang", "n_chars"]
    mine = docs.select(F.xxhash64("doc_id", *columns).alias("row"), "doc_id", *columns)
    # Of rows that repeat a labelled id, the one of least row hash is fitted on.
    one = mine.join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min_by(F.struct(*columns), "row").alias("of"))
    text, meta, keys = _features(one.select(F.concat_ws(":", F.xxhash64("doc_id"), "quality").alias("key"), "of.*"), p.buckets)
    if not keys:
        return QualityModel(*(Logistic(np.zeros(n), np.ones(n), np.zeros(n), 0.0) for n in (_SHAPES + p.buckets, _META, 2)))
    y = np.array([float(k.rpartition(":")[2]) for k in keys])
    fits = {"text": ([text], [y]), "meta": ([meta], [y])}
    fitted = lambda: {view: Logistic.fit(np.concatenate(x), np.concatenate(v)) for view, (x, v) in fits.items()}
    models = fitted()
    work = Workspace(docs.sparkSession, "co-training")
    exchange: list[HandOver] = []
    past: list[Round] = []
    for turn in range(p.rounds if p.pool > 0 else 0):
        unlabelled = work.save(_scored(mine, models, past, p.buckets).join(known, "doc_id", "left_anti"), f"round-{turn}")
        counts = {"text": Counter(), "meta": Counter()}
        for view, step, n in unlabelled.selectExpr("stack(2, 'text', text, 'meta', meta) as (view, step)").where("step is not null").groupBy("view", "step").count().collect():
            counts[view][step] = n
        share = p.pool * (turn + 1) // p.rounds - p.pool * turn // p.rounds
        drawn: dict[str, dict[int, float]] = {}
        bars = {giver: _bars(counts[giver], float(y.mean()), p) for giver in counts}
        for giver, (low, high) in bars.items():
            passed = unlabelled.where((F.col(giver) <= low) | (F.col(giver) >= high)).groupBy("row").agg(F.first(F.col(giver) >= high).alias("good"))
            rows = least_by_hash(passed, "row", share, hashed=True).collect()
            drawn[giver] = {row: float(good) for row, good in rows}
            good, bad = (sum(n for step, n in counts[giver].items() if test(step)) for test in (lambda s: s >= high, lambda s: s <= low))
            exchange.append(HandOver(turn, giver, sum(counts[giver].values()), good, bad, len(drawn[giver])))
            log.info("%s", exchange[-1])
        work.drop(f"round-{turn}")
        past.append((models, bars))
        wanted = sorted({row for rows in drawn.values() for row in rows})
        if not wanted:
            break
        new_text, new_meta, found = _features(mine.where(F.col("row").isin(wanted)).select(F.col("row").alias("key"), *columns), p.buckets)
        place = {row: i for i, row in enumerate(found)}
        for giver, taker, features in (("text", "meta", new_meta), ("meta", "text", new_text)):
            if drawn[giver]:
                fits[taker][0].append(features[[place[row] for row in drawn[giver]]])
                fits[taker][1].append(np.array(list(drawn[giver].values())))
        models = fitted()
    # Each labelled row's odds come from views that were fitted without its fold.
    odds, fold = np.zeros((len(y), 2)), np.arange(len(y)) % p.folds
    for k in range(p.folds):
        inside, outside = fold == k, fold != k
        for column, (view, x) in enumerate((("text", text), ("meta", meta))):
            rows, marks = [x[outside], *fits[view][0][1:]], [y[outside], *fits[view][1][1:]]
            if inside.any() and sum(map(len, marks)):
                odds[inside, column] = np.clip(Logistic.fit(np.concatenate(rows), np.concatenate(marks)).odds(x[inside]), -20, 20)
    return QualityModel(models["text"], models["meta"], Logistic.fit(odds, y, 1e-3), tuple(exchange))


def score_quality(docs: DataFrame, labels: DataFrame, params: CoTrainingParams | None = None) -> DataFrame:
    """(doc_id, p_text, p_meta, p_quality, kept, row_key), a row for each input row.

    Null and empty texts and null metadata have features of their own and are scored like
    others.  Rows with null or repeated ids are scored as they are.  Columns beyond
    doc_id, text, source, lang, n_chars are not read.  An empty table gives an empty
    result.  If no document has a usable label, all probabilities are a half, and all
    documents are kept.
    """
    p = params or CoTrainingParams()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", "n_chars")
    model = train(docs, labels, p) if not rows.isEmpty() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = metadata_view(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            for lo, text in text_view(batch.column(1), p.buckets):
                parts = [np.asarray(x, np.float64) for x in model.score(text, meta[lo : lo + len(text)])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + len(text)], *map(pa.array, parts), pa.array(parts[2] >= p.threshold), batch.column(5)[lo : lo + len(text)]], ["doc_id", "p_text", "p_meta", "p_quality", "kept", "row_key"])

    return rows.withColumn("row_key", F.xxhash64("text", "source", "lang", "n_chars")).mapInArrow(run, "doc_id long, p_text double, p_meta double, p_quality double, kept boolean, row_key long")


def keep_good(docs: DataFrame, labels: DataFrame, params: CoTrainingParams | None = None) -> DataFrame:
    """The rows of docs that are kept, all columns as they are, scored in the same pass."""
    p = params or CoTrainingParams()
    model = train(docs, labels, p) if not docs.isEmpty() else None
    place = {c: i for i, c in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = metadata_view(*(batch.column(place[c]).to_pylist() for c in ("source", "lang", "n_chars")))
            for lo, text in text_view(batch.column(place["text"]), p.buckets):
                chance = model.score(text, meta[lo : lo + len(text)])[2]
                yield batch.slice(lo, len(text)).filter(pa.array(chance >= p.threshold))

    return docs.mapInArrow(run, docs.schema)
