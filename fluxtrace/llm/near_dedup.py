"""Near-duplicate documents: SuperMinHash, banding, exact verification, union-find.

1. One scan makes each document's set of word shingles and from it a 128-bit set
   key, a SuperMinHash signature cut into band keys, and a 256-bit sketch.
2. Documents with equal sets form a class at once; its least id stands for it.
3. Representatives that share a band key are candidates.  Pairs whose sizes rule a
   link out, or whose sketches differ in more bits than a link ever shows, are left out.
4. Candidates are confirmed on their full sets; union-find joins linked documents
   (``lsh`` says how, without all pairs of a bucket).
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
from .textbuf import GOLDEN, hashed_words, lower_ascii, mix64, shingle_hashes, slices, utf8_buffer
from .workspace import Workspace


@dataclass(frozen=True)
class NearDedupParams:
    """percent: two documents link if 100 * intersection >= percent * union.

    bands, rows: a pair at 75 % shares a band with chance 1 - (1 - 0.75**5)**40,
    above 0.99998.  far_bits: a linked pair's 256-bit sketches differ in 32 bits on
    average (standard deviation 5.3); beyond 68, over six deviations, a pair is left out.
    """

    width: int = 5
    percent: int = 75
    positions: int = 256
    bands: int = 40
    rows: int = 5
    far_bits: int = 68


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For slices of rows: the first row's number and each row's sorted distinct shingle hashes."""
    data, bounds = utf8_buffer(column)
    for lo, hi in slices(bounds):
        part = lower_ascii(data[bounds[lo] : bounds[hi]])
        words, by_row = hashed_words(part, bounds[lo : hi + 1] - bounds[lo])
        shingles, cuts = shingle_hashes(words, by_row, width)
        yield lo, [np.unique(shingles[cuts[i] : cuts[i + 1]]) for i in range(hi - lo)]


_FINGERPRINT = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def _fingerprints(p: NearDedupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SuperMinHash(p.positions)
        for batch in batches:
            ids = batch.column(0)
            for lo, sets in _sets(batch.column(1), p.width):
                sizes = np.array([len(s) for s in sets], np.int64)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                elements = np.concatenate(sets)
                keys = np.zeros((2, len(sets)), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    keys[0, full] = np.add.reduceat(mix64(elements), cuts[:-1][full])
                    keys[1, full] = np.add.reduceat(mix64(elements ^ GOLDEN), cuts[:-1][full])
                signatures = hasher.signatures(elements, cuts)
                bands = band_keys(signatures, p.bands, p.rows)
                sketch = bit_sketch(signatures)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * p.bands, pa.int32()), pa.array(bands.ravel()))
                columns = [ids[lo : lo + len(sets)], sizes, keys[0].view(np.int64), keys[1].view(np.int64), lists, *sketch.T]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], ["doc_id", "n_shingles", "key_a", "key_b", "bands", "s0", "s1", "s2", "s3"])

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in _sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + len(sets)], pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "elements"])

    return run


def near_duplicates(docs: DataFrame, params: NearDedupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (doc_id, n_shingles, component_id, kept), a row for each input row.

    component_id is the least id reachable by links, the document itself included;
    kept is whether that is the document's own id.  A null, empty or blank text has
    no shingles and links with nothing.  A row with a null id links with nothing,
    has a null component_id and is kept.  Rows that repeat an id count as one
    document with all their links.  Other columns are neither read nor returned.
    An empty table gives an empty result.
    """
    p = params or NearDedupParams()
    work, linking = Workspace(docs.sparkSession, "near-dedup"), Workspace(docs.sparkSession, "near-links")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = work.save(source.mapInArrow(_fingerprints(p), _FINGERPRINT), "prints")
    known = prints.where("n_shingles > 0 and doc_id is not null")
    classes = work.save(known.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = work.save(known.alias("k").join(classes.alias("c"), (F.col("k.doc_id") == F.col("c.rep")) & (F.col("k.key_a") == F.col("c.key_a")) & (F.col("k.key_b") == F.col("c.key_b")), "left_semi"), "reps")

    def sets_of(nodes: DataFrame) -> DataFrame:
        rows = source.hint("merge").join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
        return rows.mapInArrow(_full_sets(p.width), "node long, elements binary")

    sketches = reps.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "s0", "s1", "s2", "s3")
    found = linked_components(reps.selectExpr("doc_id as node", "bands", "n_shingles as n", "s0", "s1", "s2", "s3"), sketches, 4, p.far_bits, p.percent, sets_of, linking)

    of_set = F.struct("key_a", "key_b", "n_shingles").alias("of_set")
    whole = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(of_set, F.coalesce("component", "rep").alias("component"), "copies")
    whole = work.save(whole, "components")
    linking.remove()
    work.drop("classes", "reps")
    # Sets with very many copies are spread over tasks; rows without a set or an id don't join at all.
    hot = skew.hot_keys(whole, "of_set", "copies", whole.agg(F.sum("copies")).first()[0] or 0)
    joined = skew.joined(known.select("doc_id", "n_shingles", of_set), whole.select("of_set", "component"), "of_set", hot, "doc_id")
    alone = prints.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    every = joined.select("doc_id", "n_shingles", "component").unionByName(alone)
    return every.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, params: NearDedupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that are kept, all columns as they are; of rows that repeat an id all stay or go."""
    found = near_duplicates(docs, params, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id"), F.lit(0).alias("gone_salt"))
    number = F.col(id_col).cast("long")
    # Rows with a null id all stay; the second key spreads them over tasks.
    salt = F.when(number.isNull(), F.pmod(F.xxhash64(text_col), F.lit(skew.SALTS))).otherwise(0).cast("int")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), number.alias("id"), salt.alias("salt"))
    return rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("salt") == F.col("gone_salt")), "left_anti").select("doc.*")
