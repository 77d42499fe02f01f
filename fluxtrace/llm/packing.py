"""Packing by powers of two: a document's tokens are cut into pieces of binary lengths.

A document of n tokens gives n // most pieces of the greatest length and one piece for each bit
of the rest, the longest first.  Pieces of one length make a bucket, of which batches are drawn:
each piece is a sequence by itself, so no sequence crosses documents, none is padded, and no
attention mask is needed.  Everything happens in one pass over the texts, without a shuffle.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import AbstractContextManager
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .cache import Generations, borrowed
from .textbuf import slices, utf8_buffer

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# How tokenizers of this kind split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@dataclass(frozen=True)
class PackingParams:
    """most: the longest sequence, a power of two.  end_id: appended to each document."""

    tokenizer: str = TOKENIZER
    end_id: int = 2
    most: int = 4096


class ChunkEncoder(Generations):
    """Words and other chunks of text to their ids as little-endian unsigned 32-bit integers.

    For tokenizers that drop white space before they split, and whose normaliser neither joins nor
    looks across it: then a text's ids are those of what stands between ASCII white space.  If the
    tokenizer splits by ``WORDS``, text of common Latin characters, which no normal form changes
    but for their case, is split here, and the library's merges are applied to new words.  The
    whole library encodes all other chunks.
    """

    #: Bytes of chunks that the library gets in one call.
    TOGETHER = 1 << 20
    #: Bytes of text whose words are looked up together.
    SLICE = 1 << 17
    LETTERS = "a-zß-öø-ÿ"
    PLAIN = re.compile("[ \\t-\\r!-~À-ÖØ-öø-ÿ¡¿«»–—‘’“”…]*")
    #: What ``WORDS`` takes beside runs of letters; spaces around it leave words to split at white space.
    APART = re.compile(f"[^{LETTERS} \\t-\\r](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<![0-9])[^{LETTERS}0-9 \\t-\\r]+)?")
    #: Bytes that the byte-level alphabet writes as other characters: its rule for what isn't printable.  The space stays, it parts words here.
    UNPRINTABLE = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173]) if b != 32}
    WRITTEN = "".join(map(chr, range(256))).translate(UNPRINTABLE)

    def __init__(self, path: str, most: int = 64 << 20) -> None:
        super().__init__(most)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (setup.get("normalizer") or {}).get("normalizers", [])]
        first = (setup.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.splits = kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": WORDS} and first.get("invert", False)
        self.merge = self.tokenizer.model.tokenize
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else "(?!)")
        for text in ("a  b\n\tc", " é́ 'S x "):
            if self._ids([text]) != [b"".join(self._ids(text.split()))]:
                raise ValueError("the tokenizer must drop white space and encode what lies between on its own")

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        return self.splits and self.PLAIN.fullmatch(text) is not None and self.added.search(text) is None

    def _keys(self, raw: bytes) -> list[str]:
        """A text's words where they are plain, its chunks elsewhere."""
        text = raw.decode("utf-8")
        if self._plain(text):
            return self.words(text)
        chunks = [c.decode("utf-8") for c in raw.split()]
        return list(chain.from_iterable(self.words(c) if self._plain(c) else [c] for c in chunks))

    def words(self, text: str) -> list[str]:
        """A plain text's words."""
        return self.APART.sub(r" \g<0> ", text.lower()).split()

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of plain words."""
        text = " ".join(words)
        if not text.isascii():
            text, _ = codecs.charmap_decode(text.encode(), "strict", self.WRITTEN)
        found = [[t.id for t in self.merge(word)] for word in text.split()]
        ends = np.cumsum([0, *map(len, found)]) * 4
        raw = np.fromiter(chain.from_iterable(found), "<u4", ends[-1] // 4).tobytes()
        return [raw[a:b] for a, b in pairwise(ends.tolist())]

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        """The ids of words and chunks that aren't remembered."""
        odd = [] if self._plain(" ".join(keys)) else [k for k in keys if not self._plain(k)]
        learnt, at, size = dict.fromkeys(odd, b""), 0, 0
        for end, chunk in enumerate(odd, 1):
            size += len(chunk)
            if size >= self.TOGETHER or end == len(odd):
                learnt.update(zip(odd[at:end], self._ids(odd[at:end]), strict=True))
                at, size = end, 0
        words = [k for k in keys if k not in learnt] if odd else keys
        learnt.update(zip(words, self.merged(words), strict=True))
        self.keep_all(learnt)
        return learnt

    def rows(self, column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """For slices of rows: the first row's number and each row's ids."""
        data, bounds = utf8_buffer(column)
        for lo, hi in slices(bounds, self.SLICE):
            keys = [self._keys(data[bounds[i] : bounds[i + 1]].tobytes()) for i in range(lo, hi)]
            flat = list(chain.from_iterable(keys))
            parts = list(map(self.get, flat))
            gaps = [i for i, x in enumerate(parts) if x is None]
            if gaps:
                wanted = dict.fromkeys([flat[i] for i in gaps])
                found = self.recall_all(wanted)
                found |= self._learn([c for c in wanted if c not in found])
                for i in gaps:
                    parts[i] = found[flat[i]]
            ends = np.cumsum([0, *map(len, keys)]).tolist()
            yield lo, [b"".join(parts[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=2)
def _loaded(path: str) -> ChunkEncoder:
    """One for each Python worker and tokenizer."""
    return ChunkEncoder(path)


def encoder(path: str) -> AbstractContextManager[ChunkEncoder]:
    """The worker's encoder, for a task."""
    coder = _loaded(path)
    return borrowed(coder, coder)


def binary_lengths(n: int, most: int) -> list[int]:
    """Powers of two that add up to n, none over ``most``, the longest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, params: PackingParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) for each piece.

    start: the document's ids before the piece; doc_tokens: all ids of the document, its end id
    included; ids: the piece's, little-endian unsigned 32-bit integers in a binary; offset: always
    0, as each piece fills its sequence.  sequence_id holds the bucket (the length's binary
    logarithm) in its upper bits, then the number of the task and of the piece in it: ids of a
    bucket lie together, and are unique in one evaluation, so write the result before it is read
    twice (``write_buckets``).

    A null or empty text is the end id alone; rows with a null or repeated id are packed as they are;
    other columns are neither read nor returned; an empty table gives an empty result.
    """
    p = params or PackingParams()
    if p.most < 1 or p.most & (p.most - 1):
        raise ValueError("the longest sequence must be a power of two")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, end, numbers = TaskContext.get().partitionId() << 32, np.array([p.end_id], "<u4").tobytes(), Counter()
        with encoder(p.tokenizer) as coder:
            for batch in batches:
                for lo, rows in coder.rows(batch.column(1)):
                    at, starts, lengths, totals, sequences, parts = [], [], [], [], [], []
                    for i, ids in enumerate(rows, lo):
                        ids += end
                        total, start = len(ids) // 4, 0
                        for length in binary_lengths(total, p.most):
                            at.append(i)
                            starts.append(start)
                            lengths.append(length)
                            totals.append(total)
                            sequences.append((length.bit_length() - 1 << 58) + task + numbers[length])
                            numbers[length] += 1
                            parts.append(ids[4 * start : 4 * (start + length)])
                            start += length
                    columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, totals, sequences)), pa.array(np.zeros(len(at), np.int64)), pa.array(parts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Writes pieces as Parquet, a folder for each bucket; Spark's committer leaves one attempt of each task."""
    pieces.write.partitionBy("length").parquet(folder)


def read_bucket(spark: SparkSession, folder: str, length: int) -> DataFrame:
    """The sequences of one length; only that bucket's files are read."""
    return spark.read.parquet(folder).where(F.col("length") == length)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
