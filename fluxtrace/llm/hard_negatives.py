"""Hard-negative mining by a two-dimensional block matrix multiply, summed over the network.

Vectors are quantised to integers and packed into blocks of rows, each cut into chunks of
dimensions.  Anchors are packed likewise.  A block of rows meets a block of anchors once for
each chunk; the partial score tiles of int64 are shuffled to the tile's place and added there,
one at a time, and a finished tile leaves only the best few of each of its anchors:

1. the best rows of the anchor's own label are its positives;
2. for each positive, the best rows of other labels whose score lies in the positive's window
   are its negatives.  Their tiles are made anew, since no tile outlives its task.

Every anchor meets every row, so the work is anchors times rows times dimensions, in tiles of
bounded size that know nothing of labels; a label with a third of all rows makes no large group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace


@dataclass(frozen=True)
class MiningParams:
    """positives, negatives: how many of each.  low, high: a negative's score in per cent of its
    positive's, both included.  scale: a component x becomes floor(scale * x).  rows, anchors,
    chunk: rows, anchors and dimensions of a tile; its scores take 8 * rows * anchors bytes."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: float = 256.0
    rows: int = 1024
    anchors: int = 256
    chunk: int = 32


#: Rows of tiles or of chunks that a Python function gets at once.
TILES_AT_ONCE = 4
#: Blocks of rows that meet a block of anchors in one group of a join.
BLOCKS_TOGETHER = 16

_BLOCK = "block long, chunk int, ids binary, labels binary, anchor binary, kind string, vectors binary"
_ANCHOR = "block long, place int, chunk int, id long, label long, kind string, vector binary"
_PANEL = "ablock int, chunk int, a_ids binary, a_labels binary, a_blocks binary, a_places binary, a_kind string, a_vectors binary"
_TOP = "ablock int, a int, anchor_id long, k int, positive_id long, positive_score long, id long, score long"


def quantised(vectors: DataFrame, anchor: Column, p: MiningParams, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, anchor, v): the rows that take part, their components as integers."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * p.scale))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), v.alias("v"))


def _kind(values: np.ndarray) -> str:
    """The narrowest integers that hold the values."""
    most = max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))
    return next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max or k == "<i8")


def _pack(rows: DataFrame, width: int, p: MiningParams) -> DataFrame:
    """Blocks of rows in the order of id, a row for each chunk of dimensions; short vectors end in zeros."""

    def blocks(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        lists = table["v"].combine_chunks()
        matrix = np.zeros((len(order), width), np.int64)
        lengths = np.diff(lists.offsets.to_numpy())
        matrix[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
        matrix = matrix[order]
        shared = [table[c].to_numpy()[order].astype(kind).tobytes() for c, kind in (("id", "<i8"), ("label", "<i8"), ("anchor", "u1"))]
        for chunk in range(max(1, -(-width // p.chunk))):
            part = matrix[:, chunk * p.chunk : (chunk + 1) * p.chunk]
            kind = _kind(part)
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "chunk", "ids", "labels", "anchor", "kind", "vectors"), (number, chunk, *shared, kind, part.astype(kind).tobytes()), strict=True))], schema=_BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, p.rows - n)
                held, n, at = [*held, part], n + part.num_rows, at + part.num_rows
                if n == p.rows:
                    yield from blocks(held, number)
                    held, n, number = [], 0, number + 1
        if n:
            yield from blocks(held, number)

    return rows.mapInArrow(run, _BLOCK)


_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("anchor", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary())])
_ANCHOR_SCHEMA = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("chunk", pa.int32()), ("id", pa.int64()), ("label", pa.int64()), ("kind", pa.string()), ("vector", pa.binary())])
_PANEL_SCHEMA = pa.schema([("ablock", pa.int32()), ("chunk", pa.int32()), *((c, pa.binary()) for c in ("a_ids", "a_labels", "a_blocks", "a_places")), ("a_kind", pa.string()), ("a_vectors", pa.binary())])


def _matrix(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1) if raw else np.zeros((n, 0), np.int64)


def _anchor_panels(blocks: DataFrame, count: int) -> DataFrame:
    """Anchors dealt by hash into ``count`` blocks, a row for each of these and each chunk."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(row["anchor"], np.uint8))
                if len(at):
                    ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
                    part = _matrix(row["vectors"], row["kind"], len(ids))[at]
                    columns = [pa.array(np.full(len(at), row["block"])), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), row["chunk"], np.int32)), pa.array(ids[at]), pa.array(labels[at]), pa.array([row["kind"]] * len(at)), pa.array([x.tobytes() for x in part], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=_ANCHOR_SCHEMA)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("place", "ascending")])
        raw = [np.frombuffer(v, k).astype(np.int64) for v, k in zip(table["vector"].to_pylist(), table["kind"].to_pylist(), strict=True)]
        matrix = np.stack(raw)
        kind = _kind(matrix)
        shared = [table[c].to_numpy().astype("<i8").tobytes() for c in ("id", "label", "block", "place")]
        return pa.Table.from_pylist([dict(zip(_PANEL_SCHEMA.names, (key[0].as_py(), key[1].as_py(), *shared, kind, matrix.astype(kind).tobytes()), strict=True))], schema=_PANEL_SCHEMA)

    rows = blocks.mapInArrow(unpack, _ANCHOR).withColumn("ablock", F.pmod(F.xxhash64("block", "place"), F.lit(count)).cast("int"))
    return rows.groupBy("ablock", "chunk").applyInArrow(pack, _PANEL)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in int64 (modulo 2**64); by floating point where all sums are exact there."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``most`` highest allowed scores of each row, the first columns of equals."""
    least = np.iinfo(np.int64).min
    shown = np.where(allowed, scores, least)
    n = shown.shape[1]
    bar = np.partition(shown, n - most, axis=1)[:, n - most] if n > most else np.full(len(shown), least)
    row, column = np.nonzero(allowed & (shown >= bar[:, None]))
    order = np.lexsort((column, ~shown[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < most
    return row[keep], column[keep]


def _window(positive: np.ndarray, p: MiningParams) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score between low and high per cent, without products that overflow."""
    whole, rest = positive // 100, positive % 100
    return p.low * whole - (-p.low * rest) // 100, p.high * whole + (p.high * rest) // 100


@dataclass
class _Tile:
    """A finished tile: scores of anchors (rows) against rows (columns)."""

    row: dict
    scores: np.ndarray

    def __post_init__(self) -> None:
        self.ids, self.labels, self.a_ids, self.a_labels, self.a_blocks, self.a_places = (np.frombuffer(self.row[c], "<i8") for c in ("ids", "labels", "a_ids", "a_labels", "a_blocks", "a_places"))
        self.same = self.a_labels[:, None] == self.labels

    def found(self, k: np.ndarray | int, a: np.ndarray, at: np.ndarray, positive: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
        n = len(a)
        own = positive or (np.zeros(n, np.int64), np.zeros(n, np.int64))
        columns = [np.full(n, self.row["ablock"], np.int32), a.astype(np.int32), self.a_ids[a], np.full(n, k, np.int32), *own, self.ids[at], self.scores[a, at]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ablock", "a", "anchor_id", "k", "positive_id", "positive_score", "id", "score"])


def _positives(p: MiningParams) -> Callable[[_Tile], Iterator[pa.RecordBatch]]:
    def reduce(tile: _Tile) -> Iterator[pa.RecordBatch]:
        allowed = tile.same.copy()
        mine = np.flatnonzero(tile.a_blocks == tile.row["block"])
        allowed[mine, tile.a_places[mine]] = False
        yield tile.found(0, *best(tile.scores, allowed, p.positives))

    return reduce


def _negatives(p: MiningParams) -> Callable[[_Tile], Iterator[pa.RecordBatch]]:
    def reduce(tile: _Tile) -> Iterator[pa.RecordBatch]:
        chosen = [(x["k"], x["a"], x["id"], x["score"]) for x in tile.row["positives"] or []]
        k, a, ids, scores = (np.array([x[i] for x in chosen], np.int64) for i in range(4))
        for number in np.unique(k):
            mine = k == number
            low, high = _window(scores[mine], p)
            part = tile.scores[a[mine]]
            row, at = best(part, ~tile.same[a[mine]] & (part >= low[:, None]) & (part <= high[:, None]), p.negatives)
            yield tile.found(number, a[mine][row], at, (ids[mine][row], scores[mine][row]))

    return reduce


def _tiles(blocks: DataFrame, panels: DataFrame, count: int, groups: int, reduce: Callable[[_Tile], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``reduce`` leaves of each finished tile."""
    left = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("ablock", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    right = panels.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = left.drop("anchor").join(right, ["ablock", "g", "chunk"]).drop("g")
    carried = [f for f in pairs.schema.fields if f.name not in ("kind", "vectors", "a_kind", "a_vectors")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried) + ", tile binary"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = []
            for row in batch.select(["ids", "kind", "vectors", "a_ids", "a_kind", "a_vectors"]).to_pylist():
                a, b = _matrix(row["a_vectors"], row["a_kind"], len(row["a_ids"]) // 8), _matrix(row["vectors"], row["kind"], len(row["ids"]) // 8)
                tiles.append(product(a, b).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), pa.array(tiles, pa.binary())], [*(f.name for f in carried), "tile"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None

        def finished() -> Iterator[pa.RecordBatch]:
            if last is not None:
                yield from reduce(_Tile(last, total.reshape(len(last["a_ids"]) // 8, -1)))

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                part = np.frombuffer(row.pop("tile"), "<i8")
                if last is not None and (row["block"], row["ablock"]) == (last["block"], last["ablock"]):
                    total += part
                else:
                    yield from finished()
                    last, total = row, part.copy()
        yield from finished()

    partial = pairs.mapInArrow(multiply, schema)
    return partial.repartition("block", "ablock").sortWithinPartitions("block", "ablock").mapInArrow(add, _TOP)


def _ranked(found: DataFrame, most: int, *keys: str) -> DataFrame:
    """Of what tiles left, the best of each key, with rank from 1; Spark drops the rest before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine_hard_negatives(vectors: DataFrame, anchor: Column, params: MiningParams | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: which rows are anchors; null counts as no.  Labels are integers.  Rows with a null id,
    label or vector, or a component that is null or not finite, take no part.  Vectors of unequal
    length end in zeros; an empty one scores 0 with all.  Components beyond 64 bits stop at their
    ends, and scores beyond wrap around.  Rows that repeat an id are rows of their own: each is an
    anchor if the first is, and another row to it.  Ties go to the lesser id.  An anchor without a
    positive, or a positive without a row in its window, gives nothing; an empty table nothing.
    Other columns are neither read nor returned.
    """
    p = params or MiningParams()
    spark = vectors.sparkSession
    rows = quantised(vectors, anchor, p, id_col, label_col, vector_col)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    sizes = rows.agg(F.max(F.size("v")).alias("width"), F.count_if("anchor").alias("anchors")).head()
    if not sizes.anchors:
        return spark.createDataFrame([], result)
    work = Workspace(spark, "hard-negatives")
    blocks = work.save(_pack(rows, sizes.width, p), "blocks", p.rows)
    count = -(-sizes.anchors // p.anchors)
    groups = -(-blocks.where("chunk = 0").count() // BLOCKS_TOGETHER)
    panels = work.save(_anchor_panels(blocks, count), "anchors", TILES_AT_ONCE)
    tops = work.save(_tiles(blocks, panels, count, groups, _positives(p)), "positive-tiles", TILES_AT_ONCE)
    positives = _ranked(tops, p.positives, "ablock", "a")
    chosen = positives.groupBy("ablock").agg(F.collect_list(F.struct("a", F.col("rank").alias("k"), "id", "score")).alias("positives"))
    with_windows = work.save(panels.join(chosen, "ablock"), "windows", TILES_AT_ONCE)
    work.drop("positive-tiles", "anchors")
    tops = work.save(_tiles(blocks, with_windows, count, groups, _negatives(p)), "negative-tiles", TILES_AT_ONCE)
    work.drop("blocks", "windows")
    found = _ranked(tops, p.negatives, "ablock", "a", "k")
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
