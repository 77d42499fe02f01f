"""Fuzzy duplicate lines across all documents: one line of each component stays.

1. One scan gives each line a 64-bit key of its whole text, a MinHash signature over
   its shingles of eight characters, cut into band keys, and a 64-bit sketch.
2. Lines with equal text share a key; keys that share a band are candidates (``lsh``).
3. Candidates are confirmed on the exact Jaccard similarity of their shingle sets.
4. Union-find joins linked keys; a component's line at the least (doc_id, line number)
   stays and all its other lines go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew
from .lsh import linked_components
from .superminhash import SuperMinHash, band_keys, bit_sketch
from .textbuf import GOLDEN, mix64, slices, utf8_buffer
from .workspace import Workspace


@dataclass(frozen=True)
class LineDedupParams:
    """percent: two lines link if 100 * intersection >= percent * union of their shingle sets.

    bands, rows: a pair at 75 % shares a band with chance 1 - (1 - 0.75**3)**12, above
    0.998; at 80 % above 0.9996.  far_bits: a linked pair's 64-bit sketches differ in 8 bits
    on average (standard deviation 2.6); beyond 24, with a chance below 1e-7, a pair is left out.
    """

    width: int = 8
    percent: int = 75
    positions: int = 64
    bands: int = 12
    rows: int = 3
    far_bits: int = 24


_FACTORS = mix64((np.arange(64, dtype=np.uint64) + np.uint64(901)) * GOLDEN) | np.uint64(1)


def _lines(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: the first row's number, code points, each line's bounds (start, end), and its row in the slice."""
    data, bounds = utf8_buffer(column)
    for lo, hi in slices(bounds):
        part = data[bounds[lo] : bounds[hi]]
        codes = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        cut = bounds[lo : hi + 1] - bounds[lo]
        if len(codes) != len(part):
            cut = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[cut]
        breaks = np.flatnonzero(codes == 10)
        starts = np.concatenate([cut[:-1], breaks + 1])
        ends = np.concatenate([breaks, cut[1:]])
        owner = np.concatenate([np.arange(hi - lo), np.searchsorted(cut, breaks, "right") - 1])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        order = np.lexsort((ends, np.concatenate([np.searchsorted(cut, breaks, "right") - 1, np.arange(hi - lo)])))
        yield lo, codes, np.stack([starts, ends[order]]), owner


def _spread(bounds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start .. start + size - 1 of every line in order, and each line's bounds among them."""
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(bounds[0] - cuts[:-1], sizes) + np.arange(cuts[-1]), cuts


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """For each position the hash of ``width`` characters from there on, by doubling."""
    x = codes.astype(np.uint64) + np.uint64(1)
    out, done, step, part = None, 0, 1, x
    while True:
        if width & step:
            out = part if out is None else out[: len(part) - done] * _FACTORS[done] + part[done:] if done else part
            done += step
        if done == width:
            return mix64(out)
        part = part[:-step] * _FACTORS[32 + step] + part[step:]
        step *= 2


def _shingles(codes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each line's windows of ``width`` characters; a shorter line is one window."""
    lengths = bounds[1] - bounds[0]
    sizes = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    first, cuts = _spread(bounds, sizes)
    # Zeros after the text stand for the missing characters of short lines.
    out = _windows(np.concatenate([codes, np.zeros(width, np.uint32)]), width)[first]
    short = np.flatnonzero((lengths < width) & (lengths > 0))
    if len(short):
        out[cuts[:-1][short]] = mix64(_short_keys(codes, bounds[:, short]))
    return out, cuts


def _short_keys(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes of the whole texts of short lines."""
    lengths = bounds[1] - bounds[0]
    at, cuts = _spread(bounds, lengths)
    place = (at - np.repeat(bounds[0], lengths)).astype(np.uint64)
    values = mix64(((place << np.uint64(21)) | codes[at]) * GOLDEN + GOLDEN)
    return np.add.reduceat(values, cuts[:-1]) + lengths.astype(np.uint64) * GOLDEN


def _keys(hashes: np.ndarray, cuts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit key of each line's whole text, from its windows and their places; lines must not be empty."""
    place = np.arange(len(hashes)) - np.repeat(cuts[:-1], np.diff(cuts))
    values = hashes * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    return mix64(np.add.reduceat(values, cuts[:-1]) + lengths.astype(np.uint64) * GOLDEN).view(np.int64)


def _with_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    solid = np.concatenate([[0], np.cumsum((codes != 0x20) & (codes - np.uint32(0x09) > 4))])
    return solid[bounds[1]] > solid[bounds[0]]


#: Keys that a task remembers.
REMEMBERED = 1 << 20
_PRINT = "doc_id long, row_key long, line_no int, key long, bands array<long>, s0 long"


def _prints(p: LineDedupParams):
    """Rows (doc_id, row_key, text) to a row for each line that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = SuperMinHash(p.positions), set()
        for batch in batches:
            for lo, codes, bounds, owner in _lines(batch.column(2)):
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                keep = _with_words(codes, bounds)
                bounds, owner, number = bounds[:, keep], owner[keep], number[keep]
                if not len(owner):
                    continue
                hashes, cuts = _shingles(codes, bounds, p.width)
                keys = _keys(hashes, cuts, bounds[1] - bounds[0])
                # A text's bands are the same wherever it stands: a task gives those of a key once.
                new = np.zeros(len(keys), bool)
                first = np.unique(keys, return_index=True)[1]
                new[first] = [k not in seen for k in keys[first].tolist()]
                seen.update(keys[new].tolist())
                if len(seen) > REMEMBERED:
                    seen.clear()
                sizes = np.diff(cuts)
                signatures = hasher.signatures(hashes[np.repeat(new, sizes)], np.concatenate([[0], np.cumsum(sizes[new])]))
                bands = band_keys(signatures, p.bands, p.rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new)]) * p.bands, pa.int32()), pa.array(bands.ravel()))
                sketch = np.zeros(len(keys), np.int64)
                sketch[new] = bit_sketch(signatures)[:, 0]
                rows = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number, pa.int32()), pa.array(keys), lists, pa.array(sketch, mask=~new)],
                    ["doc_id", "row_key", "line_no", "key", "bands", "s0"],
                )

    return run


def _line_sets(width: int):
    """Lines to their sorted distinct shingle hashes."""

    def unpack(column: pa.Array) -> list[np.ndarray]:
        data, bounds = utf8_buffer(column)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(codes) != len(data):
            bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
        hashes, cuts = _shingles(codes, np.stack([bounds[:-1], bounds[1:]]), width)
        first = np.zeros(len(hashes) + 1, bool)
        first[cuts] = True
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            hashes[a:b].sort()
        fresh = first[:-1]
        fresh[1:] |= hashes[1:] != hashes[:-1]
        hashes, cuts = hashes[fresh], np.concatenate([[0], np.cumsum(fresh)])[cuts].tolist()
        return [hashes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    return unpack


def duplicate_lines(docs: DataFrame, params: LineDedupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (doc_id, row_key, dropped): for each row that loses lines, their numbers from 0.

    row_key is the 64-bit hash of the row's text, so rows that repeat an id keep apart.
    Lines are what newlines separate; a line without a word takes no part and stays.
    A null or empty text has no lines.  Lines of rows with a null id stay.  Of copies
    of a whole row each keeps the same lines.  An empty table gives an empty result.
    """
    p = params or LineDedupParams()
    work, linking = Workspace(docs.sparkSession, "line-dedup"), Workspace(docs.sparkSession, "line-links")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    prints = work.save(source.mapInArrow(_prints(p), _PRINT), "prints")
    bands = prints
    prints = work.save(prints.drop("bands"), "lines")
    where = F.struct("doc_id", "line_no", "row_key")
    known = work.save(prints.groupBy("key").agg(F.count("*").alias("copies"), F.min("s0").alias("s0")), "known")
    sketches = known.select(F.col("key").alias("node"), F.lit(1).cast("long").alias("n"), "s0")

    def sets_of(nodes: DataFrame) -> DataFrame:
        # The lines that a task met first: a very common line has few of these.
        met = prints.where("s0 is not null").join(nodes.withColumnRenamed("node", "key").hint("shuffle_hash"), "key")
        # Any of a key's places will do, as their texts are equal; the columns of the first come from one row, without a sort.
        placed = met.groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_id", "row_key", "line_no")))
        placed = placed.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("line_no", "key")).alias("lines"))
        rows = source.join(placed.hint("shuffle_hash"), ["doc_id", "row_key"]).select("lines", F.split("text", "\n").alias("texts"))
        texts = rows.select("texts", F.explode("lines").alias("line")).select(F.col("line.key").alias("node"), F.get("texts", "line.line_no").alias("elements"))
        return texts.groupBy("node").agg(F.first("elements").alias("elements"))

    entries = bands.where("s0 is not null").select(F.col("key").alias("node"), "bands", F.lit(1).cast("long").alias("n"), "s0")
    found = linked_components(entries, sketches, 1, p.far_bits, p.percent, sets_of, linking, _line_sets(p.width), lambda: work.drop("prints"), 128)
    alone = known.where("copies > 1").select("key").join(found.select(F.col("node").alias("key")), "key", "left_anti").select("key", F.col("key").alias("component"))
    shared = found.select(F.col("node").alias("key"), "component").unionByName(alone)
    total = known.agg(F.sum("copies")).first()[0] or 0
    rows = skew.joined(prints, shared, "key", skew.hot_keys(known, "key", "copies", total), "doc_id")
    rows = work.save(rows.select("component", "doc_id", "row_key", "line_no"), "shared")
    stays = work.save(rows.groupBy("component").agg(F.min(where).alias("stays"), F.count("*").alias("n")), "stays")
    gone = skew.joined(rows, stays.select("component", "stays"), "component", skew.hot_keys(stays, "component", "n", total), "doc_id").where(where != F.col("stays"))
    gone = gone.groupBy("doc_id", "row_key").agg(F.collect_set("line_no").alias("dropped"))
    gone = work.save(gone.select("doc_id", "row_key", F.sort_array("dropped").alias("dropped")), "dropped")
    work.drop("lines", "known", "shared", "stays")
    linking.remove()
    return gone


def _rebuilt(docs: DataFrame, params: LineDedupParams | None, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_id, lines, dropped, text) of each row; doc holds all its columns."""
    gone = duplicate_lines(docs, params, id_col, text_col).select(F.col("doc_id").alias("of_id"), F.col("row_key").alias("of_row"), "dropped")
    text = F.col(text_col)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), text.alias("before"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row_key"))
    rows = rows.join(gone, (F.col("doc_id") == F.col("of_id")) & (F.col("row_key") == F.col("of_row")), "left")
    lines = F.split("before", "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("dropped", i)), "\n")
    return rows.select("doc", "doc_id", lines.alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), F.when(F.col("dropped").isNull(), F.col("before")).otherwise(kept).alias("text"))


def line_report(docs: DataFrame, params: LineDedupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped, text) of each row: how many lines it has, which
    go, and the text of those that stay.  A null text stays null and has no lines."""
    rows = _rebuilt(docs, params, id_col, text_col)
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    return rows.select("doc_id", n_lines.cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), "dropped", "text")


def without_duplicate_lines(docs: DataFrame, params: LineDedupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, the texts rebuilt from the lines that stay."""
    rows = _rebuilt(docs, params, id_col, text_col)
    return rows.select(*(F.col("text").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns))
