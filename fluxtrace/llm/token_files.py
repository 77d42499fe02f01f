"""Token-id files: Arrow IPC files of fixed-size lists, and their readers.

A file holds the ids of consecutive documents, end ids included, cut into sequences
of equal length; only a file's last sequence is padded, which its mask shows.  Ids
take two bytes if the vocabulary allows.  Beside it lies an index of its documents:
id, first token within the file, and number of tokens.  Both open by memory mapping
and any sequence is a slice of the mapped bytes.

A task writes its own files under names that no other attempt uses and reports
them; only files reported by successful tasks are in the manifest, so a lost
executor or a second attempt leaves no wrong reading.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import AbstractContextManager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .cache import Generations, borrowed
from .pretokenize import pieces_of
from .textbuf import slices, utf8_buffer
from .workspace import Workspace

#: A space as byte-level vocabularies write it, and words that are encoded in one text.
_SPACE_BYTE, _TOGETHER = "\u0120", 64

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class TokenFileParams:
    tokenizer: str = TOKENIZER
    end_id: int = 2
    sequence: int = 1024
    batch: int = 256  # sequences in a record batch


class PieceEncoder:
    """Encodes texts with the tokenizers library, pre-token by pre-token.

    The library encodes each new pre-token; a cache answers for those met before.
    A byte-level tokenizer splits a pre-token no further and joins none, so the ids
    are those of the whole text.  A text with the string of an added token goes to the
    library whole.
    most: bytes of the cache.
    """

    def __init__(self, path: str, most: int = 64 << 20) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        splitter = setup.get("pre_tokenizer") or {}
        if setup.get("normalizer") or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
            raise ValueError("the tokenizer must be byte-level, without normaliser or added prefix space")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(_SPACE_BYTE) for i in range(size)])
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Generations(most)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens.  Words with one space before them go together in texts of ``_TOGETHER``
        words, which the library splits at the spaces again; tokens that begin with a space tell where."""
        words, alone = [], []
        for p in new:
            (words if p[0] == " " and p[1:].isalpha() else alone).append(p)
        groups = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        learnt: dict[str, bytes] = {}
        for group, found in zip(groups, self._ids(["".join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(self.opens[found])
            if len(starts) != len(group) or starts[0]:
                alone += group
                continue
            raw, cuts = found.tobytes(), (np.append(starts, len(found)) * self.dtype.itemsize).tolist()
            learnt.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        learnt.update(zip(alone, [x.tobytes() for x in self._ids(alone)], strict=True))
        self.known.keep_all(learnt)
        return learnt

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, raw: bytes, cut: np.ndarray) -> dict[int, bytes]:
        """The ids of rows that hold the string of an added token."""
        found = [i for i in range(len(cut) - 1) if any(t in raw[cut[i] : cut[i + 1]] for t in self.added)] if any(t in raw for t in self.added) else []
        ids = self._ids([raw[cut[i] : cut[i + 1]].decode("utf-8") for i in found]) if found else []
        return {i: x.tobytes() for i, x in zip(found, ids, strict=True)}

    def rows(self, column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """For slices of rows: the first row's number and each row's ids as bytes of ``dtype``."""
        data, bounds = utf8_buffer(column)
        for lo, hi in slices(bounds, 1 << 19):
            pieces, by_row, _ = pieces_of(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            parts = list(map(self.known.get, pieces))
            gaps = [i for i, x in enumerate(parts) if x is None]
            if gaps:
                wanted = {pieces[i] for i in gaps}
                found = self.known.recall_all(wanted)
                found |= self._learn([p for p in wanted if p not in found])
                for i in gaps:
                    parts[i] = found[pieces[i]]
            rows = by_row.tolist()
            whole = self._whole(data[bounds[lo] : bounds[hi]].tobytes(), bounds[lo : hi + 1] - bounds[lo])
            yield lo, [whole[i] if i in whole else b"".join(parts[a:b]) for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False))]


@lru_cache(maxsize=2)
def _loaded(path: str) -> PieceEncoder:
    """One for each Python worker and tokenizer."""
    return PieceEncoder(path)


def encoder(path: str) -> AbstractContextManager[PieceEncoder]:
    """The worker's encoder, for a task."""
    coder = _loaded(path)
    return borrowed(coder, coder.known)


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file system and a path in it; local files by path or file: URI, others as Arrow knows them."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


_INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "part int, uri string, n_docs long, n_tokens long"


class _Writer:
    """A token file and its index, filled batch by batch."""

    def __init__(self, uri: str, dtype: np.dtype, p: TokenFileParams) -> None:
        fs, path = _place(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.p, self.dtype, self.total, self.docs = p, dtype, 0, 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), p.sequence)), ("mask", pa.list_(pa.bool_(), p.sequence))])
        self.streams = [fs.open_output_stream(path), fs.open_output_stream(path + ".docs")]
        self.tokens = pa.ipc.new_file(self.streams[0], self.schema)
        self.index = pa.ipc.new_file(self.streams[1], _INDEX)
        self.waiting: list[bytes] = []
        self.held = 0

    def add(self, doc_ids: pa.Array, ids: list[bytes]) -> None:
        counts = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
        offsets = self.total + np.concatenate([[0], np.cumsum(counts)])
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(offsets[:-1]), pa.array(counts)], schema=_INDEX))
        self.total, self.docs = int(offsets[-1]), self.docs + len(ids)
        self.waiting += ids
        self.held += int(counts.sum())
        if self.held >= self.p.batch * self.p.sequence:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        length = self.p.sequence
        values = np.frombuffer(b"".join(self.waiting), self.dtype)
        step = self.p.batch * length
        whole = len(values) if last else len(values) // step * step
        for at in range(0, whole, step):
            part = values[at : min(at + step, whole)]
            real = len(part)
            part = np.pad(part, (0, -real % length))
            mask = np.arange(len(part)) < real
            self.tokens.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(part), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=self.schema))
        self.waiting, self.held = [values[whole:].tobytes()], len(values) - whole

    def close(self) -> None:
        self._flush(True)
        for x in (self.tokens, self.index, *self.streams):
            x.close()


def write_token_files(docs: DataFrame, folder: str, params: TokenFileParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs in ascending order of id below folder; returns their manifest, lazily:
    (part, uri, n_docs, n_tokens), files in the order of part.

    Null ids come first; rows that repeat an id follow the hash of their text.  A null
    text is empty: only the end id.  An empty table writes nothing.  Evaluate the
    manifest once, by writing it to a table: each evaluation writes its own files.
    """
    p = params or TokenFileParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri, out = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow", None
        with encoder(p.tokenizer) as coder:
            end = np.array([p.end_id], coder.dtype).tobytes()
            for batch in batches:
                for lo, ids in coder.rows(batch.column(1)):
                    out = out or _Writer(uri, coder.dtype, p)
                    out.add(batch.column(0)[lo : lo + len(ids)], [x + end for x in ids])
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([out.docs], pa.int64()), pa.array([out.total], pa.int64())], ["part", "uri", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return rows.mapInArrow(run, _MANIFEST)


class TokenFile:
    """Random access to a token file; local files are mapped, not read."""

    def __init__(self, uri: str) -> None:
        fs, path = _place(uri)
        opened = (pa.memory_map if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file)
        self.tokens = pa.ipc.open_file(opened(path))
        self.docs = pa.ipc.open_file(opened(path + ".docs"))
        self.length = self.tokens.schema.field("ids").type.list_size
        first = self.tokens.get_batch(0).num_rows if self.tokens.num_record_batches else 1
        self.per_batch = first * self.length

    def values(self, batch: int) -> np.ndarray:
        """The ids of a record batch, a view of the file's bytes."""
        return self.tokens.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence ``i``."""
        rows = self.per_batch // self.length
        batch = self.tokens.get_batch(i // rows)
        return batch.column(0)[i % rows].values.to_numpy(zero_copy_only=True), batch.column(1)[i % rows].values.to_numpy(zero_copy_only=False)

    def slice(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids start .. start + n - 1, in views of one record batch each."""
        while n > 0:
            part = self.values(start // self.per_batch)[start % self.per_batch :][:n]
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(ids of documents, first tokens, numbers of tokens) in the file's order."""
        for i in range(self.docs.num_record_batches):
            batch = self.docs.get_batch(i)
            yield batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files of a manifest.

    start counts the ids of all documents before, over all files; ids_crc32 is that of
    the ids as little-endian unsigned 32-bit integers.  The manifest, a row for each
    file, comes to the driver to lay the files end to end.
    """
    bases, total = [], 0
    for row in manifest.orderBy("part").collect():
        bases.append((row.uri, total))
        total += row.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(uri)
                at, wide = -1, np.zeros(0, "<u4")
                for doc_ids, offsets, counts in file.documents():
                    sums = []
                    for start, n in zip(offsets.tolist(), counts.tolist(), strict=True):
                        crc = 0
                        while n > 0:
                            if at != start // file.per_batch:
                                at = start // file.per_batch
                                wide = file.values(at).astype("<u4")
                            here = start % file.per_batch
                            took = min(n, len(wide) - here)
                            crc = zlib.crc32(wide[here : here + took], crc)
                            start, n = start + took, n - took
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(offsets + base), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(bases, "uri string, base long").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, params: TokenFileParams | None = None) -> DataFrame:
    """Writes the token files of docs into the shared folder and returns what ``read_token_files`` reads."""
    work = Workspace(docs.sparkSession, "token-files")
    manifest = work.save(write_token_files(docs, f"{work.folder}/files", params), "manifest")
    return read_token_files(docs.sparkSession, manifest)
