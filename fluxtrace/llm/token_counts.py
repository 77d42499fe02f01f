"""Token counts of a unigram vocabulary by a count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches.  For each position
the dynamic programme holds only the best score and its number of pieces.  Ties go
to the segment that starts first, as candidates come in the order of their starts
and replace only a worse score.  A character that no piece covers costs ten below
the least score and counts as its UTF-8 bytes (byte fallback).

No piece reaches from another character into a following space mark, so texts are
cut before each run of space marks; equal chunks are counted once and then looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import AbstractContextManager
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cache import Generations, borrowed

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Below the least score, for a character without a piece.
UNKNOWN_PENALTY = 10.0


class ViterbiCounter(Generations):
    """Chunk to its number of pieces."""

    def __init__(self, pieces: list[tuple[str, float]], most: int = 64 << 20) -> None:
        super().__init__(most)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        inner = any(SPACE in piece.lstrip(SPACE) for piece, _ in pieces)
        newline = any("\n" in piece for piece, _ in pieces)
        body = "" if newline else "\n"
        self.chunks = re.compile(r"(?s).+" if inner else f"{SPACE}+[^{SPACE}{body}]*|[^{SPACE}{body}]+|\n").findall

    def make(self, chunk: str) -> int:
        n = len(chunk)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, match in self.automaton.iter(chunk):
                matches[end].append(match)
        for end, found in enumerate(matches):
            top, pieces = None, 0
            for length, score in sorted(found, reverse=True):
                score += best[end + 1 - length]
                if top is None or score > top:
                    top, pieces = score, count[end + 1 - length] + 1
            if chunk[end] not in self.single and (top is None or best[end] + self.unknown > top):
                top, pieces = best[end] + self.unknown, count[end] + len(chunk[end].encode("utf-8"))
            best[end + 1], count[end + 1] = top, pieces
        return count[n]

    def count(self, text: str) -> int:
        """Pieces of a text with a space mark before it and for each space; none if it is empty."""
        if not text:
            return 0
        return sum(map(self.__getitem__, self.chunks(SPACE + text.replace(" ", SPACE))))


def normal_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece file without control, unknown, unused and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skipped = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not any(f(i) for f in skipped)]


@lru_cache(maxsize=2)
def _loaded(path: str) -> ViterbiCounter:
    """One for each Python worker and vocabulary."""
    return ViterbiCounter(normal_pieces(path))


def counter(path: str) -> AbstractContextManager[ViterbiCounter]:
    """The worker's counter, for a task."""
    viterbi = _loaded(path)
    return borrowed(viterbi, viterbi)


def count_tokens(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for each row; a null or empty text has none.

    Rows with a null or repeated id are counted as they are; other columns are
    neither read nor returned; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with counter(path) as viterbi:
            for batch in batches:
                counts = [viterbi.count(text.as_py() or "") for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
