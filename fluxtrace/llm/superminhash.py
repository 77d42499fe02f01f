"""SuperMinHash signatures (Ertl 2017), level by level over many sets at once.

Each element holds every rank 0 .. m-1 in exactly one of the m positions, by a
permutation of its own, and adds a random fraction; a position keeps its least
value.  That correlation lowers the variance against independent hashes.  The
kernel deals out rank 0 of all elements, then rank 1, and so on; a set leaves as
soon as all its positions are filled, since later ranks only bring larger values.

A permutation is one of 4096 drawn tables with an exclusive-or mask, both
chosen by the element's hash, so no state is held for an element.
"""

from __future__ import annotations

import numpy as np

from .textbuf import GOLDEN, mix64

EMPTY = np.uint32(0xFFFFFFFF)
_TABLES = 4096


def _step(k: int) -> np.uint64:
    return np.uint64((k * int(GOLDEN)) & 0xFFFFFFFFFFFFFFFF)


class SuperMinHash:
    """Signatures of ``size`` positions; a power of two, 256 at most."""

    def __init__(self, size: int, seed: int = 1) -> None:
        if size & (size - 1) or not 1 <= size <= 256:
            raise ValueError("size must be a power of two up to 256")
        self.size = size
        rng = np.random.Generator(np.random.PCG64(seed))
        self._ranked = np.ascontiguousarray(rng.permuted(np.tile(np.arange(size, dtype=np.uint8), (_TABLES, 1)), axis=1).T)

    def signatures(self, elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A row of uint32 for each set; EMPTY throughout for a set without elements.

        elements: well-mixed uint64 hashes, set after set; repeats change nothing.
        """
        n = len(bounds) - 1
        out = np.full(n * self.size, EMPTY, np.uint32)
        grid = out.reshape(n, self.size)
        counts = np.diff(bounds)
        base = np.repeat(np.arange(n, dtype=np.int64) * self.size, counts)
        table = (elements >> np.uint64(52)).view(np.int64)
        flip = (elements >> np.uint64(40)).astype(np.uint8) & np.uint8(self.size - 1)
        live = np.flatnonzero(counts)
        for rank in range(self.size):
            if not len(live):
                break
            mixed = mix64(elements + _step(rank)) if rank else elements  # the low bits take no part in the place
            value = mixed.astype(np.uint32) & np.uint32(0xFFFFFF) | np.uint32(rank << 24)
            np.minimum.at(out, base + (self._ranked[rank][table] ^ flip), value)
            still = (grid[live] == EMPTY).any(axis=1)
            if not still.all():
                on = np.repeat(still, counts[live])
                elements, base, table, flip, live = elements[on], base[on], table[on], flip[on], live[still]
        return grid


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` positions, the band's number included."""
    part = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    factors = mix64((np.arange(rows, dtype=np.uint64) + np.uint64(5)) * GOLDEN) | np.uint64(1)
    mixed = (part * factors).sum(axis=2, dtype=np.uint64) + (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * GOLDEN
    return mix64(mixed).view(np.int64)


def bit_sketch(signatures: np.ndarray) -> np.ndarray:
    """One bit of each position, as int64 words: sets agree in a bit with chance (1 + J) / 2."""
    bits = np.packbits((signatures & np.uint32(1)).astype(bool), axis=1)
    return np.ascontiguousarray(bits).view(np.int64)
