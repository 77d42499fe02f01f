"""Byte-level BPE by ranks: vectorised pre-tokenisation, cached pair merging, decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from contextlib import AbstractContextManager
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cache import Generations, borrowed
from .pretokenize import pieces_of
from .textbuf import slices, utf8_buffer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class PairMerger(Generations):
    """Pre-token to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = 64 << 20) -> None:
        super().__init__(most)
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.vocabulary = {rank: token for token, rank in self.ranks.items()}

    def make(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else (self._short(raw) if len(raw) <= 48 else self._long(raw))
        return np.array(ids, "<u4").tobytes()

    def _short(self, raw: bytes) -> list[int]:
        """Merges the pair of least rank, the leftmost of equals, until none is left."""
        ranks, top = self.ranks, len(self.ranks)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        of = [ranks.get(a + b, top) for a, b in zip(parts, parts[1:], strict=False)]
        while of and (best := min(of)) < top:
            i = of.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del of[i]
            if i:
                of[i - 1] = ranks.get(parts[i - 1] + parts[i], top)
            if i < len(of):
                of[i] = ranks.get(parts[i] + parts[i + 1], top)
        return [ranks[p] for p in parts]

    def _long(self, raw: bytes) -> list[int]:
        """The same merges with a heap, for pieces where searching each time would be quadratic."""
        ranks, n = self.ranks, len(raw)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        live = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            j = after[i]
            if not live[i] or end[i] != middle or j >= n or end[j] != stop:
                continue
            end[i], live[j], after[i] = stop, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                k = after[i]
                if (r := ranks.get(raw[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[i], end[k]))
            if (k := before[i]) >= 0 and (r := ranks.get(raw[k : end[i]])) is not None:
                heapq.heappush(heap, (r, k, end[k], end[i]))
        return [ranks[raw[i : end[i]]] for i in range(n) if live[i]]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_pieces(self, ids: bytes, firsts: list[int]) -> list[bytes]:
        """What each pre-token's ids say; ``firsts`` tells which id each begins with."""
        tokens = list(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return [b"".join(tokens[a:b]) for a, b in zip(firsts, [*firsts[1:], len(tokens)], strict=True)] if firsts else []


@lru_cache(maxsize=2)
def _loaded(path: str) -> PairMerger:
    """One for each Python worker and vocabulary."""
    return PairMerger(path)


def merger(path: str) -> AbstractContextManager[PairMerger]:
    """The worker's merger, for a task."""
    bpe = _loaded(path)
    return borrowed(bpe, bpe)


def encoded(column: pa.Array, bpe: PairMerger) -> Iterator[tuple[int, list[bytes], list[np.ndarray], list[list[int]]]]:
    """For slices of rows: the first row's number, each row's ids, where its pre-tokens start in code points,
    and which of its ids each pre-token begins with."""
    data, bounds = utf8_buffer(column)
    for lo, hi in slices(bounds):
        cut = bounds[lo : hi + 1] - bounds[lo]
        pieces, by_row, starts = pieces_of(data[bounds[lo] : bounds[hi]], cut)
        parts = list(map(bpe.__getitem__, pieces))
        firsts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)])
        rows = by_row.tolist()
        own = [(starts[a:b] - (starts[a] if b > a else 0), (firsts[a:b] - firsts[a]).tolist()) for a, b in zip(rows, rows[1:], strict=False)]
        yield lo, [b"".join(parts[a:b]) for a, b in zip(rows, rows[1:], strict=False)], [s for s, _ in own], [f for _, f in own]


def encode(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, piece_starts, piece_ids): ids as little-endian unsigned 32-bit integers in a
    binary; where each pre-token starts, in code points; and which id it begins with.

    A null or empty text gives empty arrays; rows with a null or repeated id are
    encoded as they are; other columns are neither read nor returned; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with merger(path) as bpe:
            for batch in batches:
                for lo, ids, starts, firsts in encoded(batch.column(1), bpe):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[lo : lo + len(ids)], pa.array(ids, pa.binary()), pa.array([s.tolist() for s in starts], pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))],
                        ["doc_id", "ids", "piece_starts", "piece_ids"],
                    )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, piece_starts array<long>, piece_ids array<long>")


def decode(tokens: DataFrame, path: str = RANKS, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids as ``encode`` returns them; null ids give an empty text.

    Bytes that are no UTF-8, as a cut in the middle of a character leaves, become U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with merger(path) as bpe:
            for batch in batches:
                texts = [bpe.decode(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def decode_pieces(tokens: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, piece, start, text): the pre-tokens of ``encode``'s rows by the offsets it kept, start in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with merger(path) as bpe:
            for batch in batches:
                for doc, ids, starts, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    texts = [x.decode("utf-8") for x in bpe.decode_pieces(ids, firsts)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(texts), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "piece", "start", "text"])

    return tokens.select("doc_id", "ids", "piece_starts", "piece_ids").mapInArrow(run, "doc_id long, piece long, start long, text string")


def round_trip(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded and its ids decoded, in one pass.

    Null, empty and repeated rows as in ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with merger(path) as bpe:
            for batch in batches:
                for lo, ids, _, _ in encoded(batch.column(1), bpe):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0)[lo : lo + len(ids)],
                            pa.array([len(x) // 4 for x in ids], pa.int64()),
                            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                            pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                        ],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
