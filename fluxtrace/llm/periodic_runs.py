"""Runs of words that repeat with a period, by the divide and conquer of Main and Lorentz.

Words are interned as integers.  A segment is halved; a repetition that crosses its middle m shows
itself in four Z-functions, which tell for each word i how far the words from i on agree with
those from m on, and how far those before i agree with those before m.  With q = |i - m| both
extensions give the longest interval of period q around them.  The halves are then searched in
the same way.  Intervals found at several middles, or with multiples of their period, are kept
once, with the smallest period.

All segments of one depth, of all texts at hand, are searched together as arrays.  Z-values that
pass sixteen words are looked up in tables of equal blocks of 2, 4, 8, ... words, so a text that
is one word over and over costs n log(n) steps as any other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbuf import slices, utf8_buffer


@dataclass(frozen=True)
class RunParams:
    """A run has ``least`` words and ``repeats`` times its period at least; repeats is 3 or more."""

    least: int = 24
    repeats: int = 3

    def __post_init__(self) -> None:
        if self.repeats < 3 or self.least < 2:
            raise ValueError("repeats must be 3 or more, least 2 or more")


#: Words that two positions are compared over one by one, before blocks are.
STEPS = 16


class Blocks:
    """Tables that give equal stretches of 2**k words equal numbers, made when they are asked for."""

    def __init__(self, words: np.ndarray) -> None:
        self.tables = [words]

    def table(self, k: int) -> np.ndarray:
        while len(self.tables) <= k:
            last, half = self.tables[-1], 1 << len(self.tables) - 1
            n, top = len(last), int(last.max()) + 1
            ahead = np.full(n, top, np.int64)
            ahead[: n - half] = last[half:]
            _, names = np.unique(last.astype(np.int64) * (top + 1) + ahead, return_inverse=True)
            if half < n:  # blocks that end beyond the words are equal to none
                names[n - half :] = n + np.arange(half)
            else:
                names = n + np.arange(n)
            self.tables.append(names)
        return self.tables[k]

    def agree(self, a: np.ndarray, b: np.ndarray, k: int, backward: bool) -> np.ndarray:
        """Whether the blocks of 2**k words from a and b on, or up to them, are equal."""
        if backward:
            a, b = a - (1 << k) + 1, b - (1 << k) + 1
        table, n = self.table(k), len(self.tables[0])
        inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < n)
        return inside & (table[np.clip(a, 0, n - 1)] == table[np.clip(b, 0, n - 1)])


def extensions(words: np.ndarray, a: np.ndarray, b: np.ndarray, backward: bool, blocks: Blocks | None) -> tuple[np.ndarray, np.ndarray]:
    """How many words from a and from b on (or back) are equal, and which pairs go on beyond ``STEPS``.

    Without blocks those stop there.  Between texts stand words that occur once.
    """
    sign = -1 if backward else 1
    length = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for _ in range(STEPS):
        step = sign * length[live]
        live = live[words[a[live] + step] == words[b[live] + step]]
        length[live] += 1
        if not len(live):
            break
    beyond = live
    if blocks is not None:
        k, stopped = 4, []
        while len(live):
            step = sign * length[live]
            equal = blocks.agree(a[live] + step, b[live] + step, k, backward)
            stopped.append((k, live[~equal]))
            live = live[equal]
            length[live] += 1 << k
            k += 1
        for most, part in stopped:
            for k in range(most - 1, -1, -1):
                step = sign * length[part]
                length[part] += blocks.agree(a[part] + step, b[part] + step, k, backward).astype(np.int64) << k
    return length, beyond


def _halves(words: np.ndarray, first: np.ndarray, last: np.ndarray, p: RunParams, deep: np.ndarray | None, text_of: np.ndarray) -> np.ndarray:
    """(start, end, period) of the runs in segments first .. last - 1, depth by depth.

    deep: marks the texts with pairs that go on beyond ``STEPS`` and leaves them out; None looks these up.
    """
    blocks, found = (Blocks(words) if deep is None else None), [np.zeros((0, 3), np.int64)]
    while True:
        keep = last - first >= p.least
        if deep is not None:
            keep &= ~deep[text_of[first]]
        first, last = first[keep], last[keep]
        if not len(first):
            break
        middle, sizes = (first + last) // 2, last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        # A run of three periods holds half a period at least on both sides of m, or of its copy at i: one word each.
        hit = np.flatnonzero((words[at] == np.repeat(words[middle], sizes)) & (words[at - 1] == np.repeat(words[middle - 1], sizes)))
        i, m = at[hit], np.repeat(middle, sizes)[hit]
        i, m = i[i != m], m[i != m]
        a, b = np.minimum(i, m), np.maximum(i, m)
        ahead, far = extensions(words, a, b, False, blocks)
        back, long = extensions(words, a - 1, b - 1, True, blocks)
        if deep is not None:
            deep[text_of[a[far]]] = deep[text_of[a[long]]] = True
        period, start, end = b - a, a - back, b + ahead
        enough = end - start >= np.maximum(p.least, p.repeats * period)
        found.append(_smallest(np.stack([start, end, period], 1)[enough]))
        first, last = np.concatenate([first, middle]), np.concatenate([middle, last])
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
    return _smallest(np.concatenate(found))


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Each interval once, with its smallest period, by start and period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _laid_out(parts: list[np.ndarray], unique: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, a word that occurs once before each and at the end; and where texts begin."""
    lengths = np.array([len(x) for x in parts], np.int64)
    begin = np.cumsum(np.concatenate([[0], lengths[:-1] + 1])) + 1
    words = np.empty(int(lengths.sum()) + len(parts) + 1, np.int64)
    words[begin - 1] = unique + np.arange(len(parts))
    words[-1] = unique + len(parts)
    for at, part in zip(begin.tolist(), parts, strict=True):
        words[at : at + len(part)] = part
    return words, begin


def runs_of(texts: list[np.ndarray], params: RunParams | None = None) -> list[np.ndarray]:
    """For each text of word ids its runs as rows (start, end, period) by start, then period."""
    p, out = params or RunParams(), [np.zeros((0, 3), np.int64)] * len(texts)

    def search(numbers: np.ndarray, deep: np.ndarray | None) -> None:
        parts = [texts[t] for t in numbers]
        words, begin = _laid_out(parts, 1 + max((int(x.max(initial=0)) for x in parts), default=0))
        end = begin + np.array([len(x) for x in parts], np.int64)
        text_of = np.repeat(np.arange(len(parts)), end - begin + 1)
        text_of = np.concatenate([text_of, text_of[-1:]])
        rows = _halves(words, begin, end, p, deep, text_of)
        own = text_of[rows[:, 0]]
        for t, (lo, hi) in enumerate(zip(np.searchsorted(own, np.arange(len(parts))), np.searchsorted(own, np.arange(len(parts)), "right"), strict=True)):
            if hi > lo and not (deep is not None and deep[t]):
                out[numbers[t]] = rows[lo:hi] - [begin[t], begin[t], 0]

    numbers = np.array([t for t, x in enumerate(texts) if len(x) >= p.least], np.int64)
    if len(numbers):
        deep = np.zeros(len(numbers), bool)
        search(numbers, deep)
        if deep.any():
            search(numbers[deep], None)
    return out


def find_runs(docs: DataFrame, params: RunParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row.

    Words are what stands between spaces and the characters U+0009 to U+000D, numbered from 0.  A
    run is a stretch of words with smallest period q that has ``least`` words and ``repeats`` * q at
    least and that no neighbouring word extends.  runs: array of (start, length, period), by
    start, then period.  collapsed: the words joined by single spaces, without those that lie in any
    run after its first q words.

    A null or empty text has no words, no runs and an empty collapsed text; rows with a null
    or repeated id are searched as they are; other columns are neither read nor returned; an
    empty table gives an empty result.
    """
    p = params or RunParams()
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_buffer(batch.column(1))
            for lo, hi in slices(bounds):
                words = [data[bounds[i] : bounds[i + 1]].tobytes().split() for i in range(lo, hi)]
                counts = [len(w) for w in words]
                interned: dict[bytes, int] = defaultdict(count().__next__)
                ids = np.fromiter(map(interned.__getitem__, chain.from_iterable(words)), np.int64, sum(counts))
                runs = runs_of(np.split(ids, np.cumsum(counts)[:-1]), p)
                collapsed = []
                for own, found in zip(words, runs, strict=True):
                    if len(found):
                        change = np.zeros(len(own) + 1, np.int64)
                        np.add.at(change, found[:, 0] + found[:, 2], 1)
                        np.add.at(change, found[:, 1], -1)
                        own = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(own))
                rows = np.concatenate(runs)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], fields=list(triple)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_long_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): for one document in ten, by the CRC-32 h of its decimal id, the words from a on repeat with period p.

    With n words and g = floor(h / 10): a = g % n, p = 1 + floor((n - a) / (3 + g % 8)); word i >= a becomes
    word a + (i - a) % p.  A row with a null id keeps its text.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string"))
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(x: Column) -> Column:
        n, g = F.size(x.w), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x.w, place(i))), " ")).otherwise(F.lit(""))

    # The words are bound by a lambda of their own, since an expression in a lambda is evaluated for each element.
    text = F.transform(F.array(F.struct(words.alias("w"))), repeated)[0]
    return docs.select(F.col(id_col).alias("doc_id"), F.when(h % 10 == 0, text).otherwise(F.col(text_col)).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``find_runs``' rows.

    start, length and period are those of the run of greatest length / period, of equals the
    first by start, then period; without a run these and exponent_milli are null.
    """
    better = lambda top, r: top.isNull() | (r.length * top.period > top.length * r.period)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    top = F.aggregate("runs", none, lambda top, r: F.when(better(top, r), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.withColumn("_top", top)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"_top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * _top.length div _top.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
