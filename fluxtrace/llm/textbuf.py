"""UTF-8 column buffers, words and 64-bit hashes as NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel handles at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 18

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; uint64 in, uint64 out."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes and the bounds of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together, one row at least."""
    at, n = 0, len(bounds) - 1
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_DEEP = 64
_BYTE_AT = mix64((np.arange(_DEEP * 256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte."""
    return _LOWER[data]


def hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of bytes other than 0x20 and 0x09-0x0D, and their bounds by row.

    A word's hash is the sum of a random value for each (position, byte), so
    that two words meet with a chance of 2**-64.
    """
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty_like(solid)
    if len(solid):
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    by_row = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), by_row
    letters = data[solid]
    rank = np.cumsum(solid)
    first = rank[starts] - 1
    lengths = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    if lengths.max() > _DEEP:
        code = (place.astype(np.uint64) << np.uint64(8)) | letters
        values = mix64((code + np.uint64(1)) * GOLDEN)
    else:
        values = _BYTE_AT[(place << 8) | letters]
    sums = np.add.reduceat(values, first)
    return mix64(sums + lengths.astype(np.uint64) * GOLDEN), by_row


_WORD_AT = mix64((np.arange(64, dtype=np.uint64) + np.uint64(77)) * GOLDEN) | np.uint64(1)


def shingle_hashes(words: np.ndarray, by_row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's windows of ``width`` words, repeats included, and their bounds.

    A row with fewer words, but not none, has one shingle: all its words.
    """
    counts = np.diff(by_row)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    if not out_bounds[-1]:
        return np.zeros(0, np.uint64), out_bounds
    first = np.repeat(by_row[:-1], sizes) + np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], sizes)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(first), np.uint64)
    length = np.repeat(np.minimum(counts, width), sizes)
    short = length < width
    for k in range(width):
        part = padded[first + k] * _WORD_AT[k]
        if short.any():
            part[short & (length <= k)] = 0
        total += part
    return mix64(total + length.astype(np.uint64) * GOLDEN), out_bounds
