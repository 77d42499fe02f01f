"""Components of similar sets from band buckets: candidates, confirmation, union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew
from .components import connected_components
from .textbuf import slices
from .workspace import Workspace

#: Members of a block of a bucket, on average.
BLOCK = 192
#: The same where members carry only their sketches.
SKETCH_BLOCK = 1024
#: Entries that a task gets all of whose buckets it searches, on average; the ranges of buckets that these are of; and
#: members that it compares together.
ENTRIES, RANGES, TOGETHER = 1 << 19, 8, 1 << 16
#: Rows of blocks whose sets are unpacked together.
GROUP = 64
#: Further rounds of centres for buckets that hold several components, at most.
TURNS = 8
#: Pairs that a centre's set goes out for at once.
LEAVES = 256
#: Pairs of rows that are compared together, of one such row at most, and cells of an incidence matrix.
PAIRS, SMALL, CELLS = 1 << 18, 4096, 1 << 22
#: Pairs of a row of blocks that are compared one by one, at most; more are compared as matrices.
FEW = 64


Sets = Callable[[pa.Array], list[np.ndarray]]


def stored_sets(column: pa.Array) -> list[np.ndarray]:
    """Sets whose elements are their sorted 64-bit hashes in a binary."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _shared(one: np.ndarray, other: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    few, many = (one, other) if len(one) <= len(other) else (other, one)
    return int(np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few)) if len(few) else 0


def _confirmed(percent: int, unpack: Sets):
    """Rows (a, share, b, elements), sorted so that a row without b, which holds the set of a, comes
    before those of its leaves, to the linked (a, b).  Only the set of the current a is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            linked: list[tuple[int, int]] = []
            for a, b, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), unpack(batch.column(3)), strict=True):
                if b is None:
                    hub, centre = a, own
                    continue
                if a != hub:
                    raise RuntimeError(f"no set came for node {a}")
                both = _shared(centre, own)
                if 100 * both >= percent * (len(centre) + len(own) - both):
                    linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in linked], pa.int64()), pa.array([y for _, y in linked], pa.int64())], ["a", "b"])

    return run


def _members(column: pa.Array, fields: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where each row's members start among all, and their fields."""
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))]), {f: flat.field(f).to_numpy() for f in fields}


Fields = dict[str, np.ndarray]


def _fits(starts: np.ndarray, left: Fields, others: np.ndarray, right: Fields, itself: np.ndarray, words: int, percent: int, far_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For rows of two columns of members, the pairs of different components that may link: row,
    ascending, and places in either column's members.  itself: which rows meet themselves; these give each
    pair once.  Small rows are compared together, larger ones as matrices."""
    work = np.diff(starts) * np.diff(others)

    def fit(i: np.ndarray, j: np.ndarray, once: np.ndarray | bool) -> np.ndarray:
        out = np.where(once, left["node"][i] < right["node"][j], left["node"][i] != right["node"][j])
        out &= left["component"][i] != right["component"][j]
        apart = sum(np.bitwise_count((left[f"s{w}"][i] ^ right[f"s{w}"][j]).view(np.uint64)).astype(np.int16) for w in range(words))
        n, m = left["n"][i], right["n"][j]
        return out & (apart <= far_bits) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)

    small = np.flatnonzero(work <= SMALL)
    for lo, hi in slices(np.concatenate([[0], np.cumsum(work[small])]), PAIRS):
        rows = small[lo:hi]
        row = np.repeat(rows, work[rows])
        k = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(work[rows])])[:-1], work[rows])
        wide = np.maximum(np.diff(others), 1)[row]
        i, j = starts[row] + k // wide, others[row] + k % wide
        keep = fit(i, j, itself[row])
        yield row[keep], i[keep], j[keep]
    for row in np.flatnonzero(work > SMALL).tolist():
        i, j = np.arange(starts[row], starts[row + 1])[:, None], np.arange(others[row], others[row + 1])
        p, q = np.nonzero(fit(i, j, itself[row]))
        yield np.full(len(p), row), p + starts[row], q + others[row]


def _fitting(batch: pa.RecordBatch, x: int, y: int, words: int, percent: int, far_bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For rows, the pairs of members of two block columns, of different components, that may link:
    row, and places in either column's flat members.  A block that meets itself gives each pair once."""
    fields = ["node", "n", "component", *(f"s{w}" for w in range(words))]
    (starts, left), (others, right) = (_members(batch.column(c), fields) for c in (x, y))
    itself = np.array([p - o == q - r and (left["node"][o:p] == right["node"][r:q]).all() for o, p, r, q in zip(starts, starts[1:], others, others[1:], strict=False)])
    for row, i, j in _fits(starts, left, others, right, itself, words, percent, far_bits):
        cuts = np.flatnonzero(np.diff(row, prepend=-1, append=-1)) if len(row) else []
        for p, q in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(row[p]), i[p:q], j[p:q]


def _shared_buckets(rows: Fields) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct entries of buckets with several, by bucket and node, and each bucket's bounds."""
    bucket, node = rows["bucket"], rows["node"]
    order = np.argsort(bucket)
    same = np.diff(bucket[order]) == 0
    kept = order[np.append(same, False) | np.append(False, same)]
    kept = kept[np.lexsort((node[kept], bucket[kept]))]
    kept = kept[np.append(True, np.any([np.diff(c[kept]) != 0 for c in rows.values()], axis=0))[: len(kept)]]
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], np.diff(bucket[kept]) != 0, [True]]))) if len(kept) else np.zeros(0, np.int64)
    kept, sizes = kept[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]  # copies may have left a bucket with one
    return kept, np.concatenate([[0], np.cumsum(sizes)])


def _by_range(words: int, ranges: int, hot: np.ndarray):
    """Rows (node, bands, n, sketch) to (range, buckets, and as many nodes, sizes and words of sketches): entries
    by ranges of buckets, those of hot buckets left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1)
            bucket = bands.flatten().to_numpy()
            of = np.repeat(np.arange(len(batch)), np.diff(bands.offsets.to_numpy()))
            part = (bucket.view(np.uint64) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            if len(hot):
                order = order[~np.isin(bucket[order], hot)]
            found, first = np.unique(part[order], return_index=True)
            cuts = pa.array(np.append(first, len(order)), pa.int32())
            of = of[order]
            columns = [bucket[order], *(batch.column(c).to_numpy()[of] for c in (0, 2, *range(3, 3 + words)))]
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.ListArray.from_arrays(cuts, pa.array(c)) for c in columns)], ["range", "bucket", "node", "n", *(f"s{w}" for w in range(words))])

    return run


def _bucket_partners(words: int, percent: int, far_bits: int):
    """Rows of ``_by_range``, a range's in one task, to (bucket, node, centre, of), of being the bucket's
    number of nodes: all nodes of buckets of more than ``SKETCH_BLOCK``, without a centre; of smaller ones those that
    may link with another node there, and the least of them if it is a node's possible partner, or the node itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.flatten().to_numpy() for c in batch.columns[1:]] for batch in batches]
        if not held:
            return
        names = ["bucket", "node", "n", *(f"s{w}" for w in range(words))]
        rows = {name: np.concatenate(c) for name, c in zip(names, zip(*held, strict=True), strict=True)}
        held.clear()
        kept, bounds = _shared_buckets(rows)
        rows = {name: c[kept] for name, c in rows.items()}
        rows["component"] = rows["node"]
        for first, last in slices(bounds, TOGETHER):
            part = {name: c[bounds[first] : bounds[last]] for name, c in rows.items()}
            starts = bounds[first : last + 1] - bounds[first]
            of = np.repeat(np.diff(starts), np.diff(starts))
            hit, fit, centre = of > SKETCH_BLOCK, np.zeros(len(of), bool), np.zeros(len(of), np.int64)
            met = np.concatenate([[0], np.cumsum(~hit)])[starts]
            inside = {name: c[~hit] for name, c in part.items()}
            place = np.flatnonzero(~hit)
            for row, i, j in _fits(met, inside, met, inside, np.ones(len(starts) - 1, bool), words, percent, far_bits):
                if not len(row):
                    continue
                cuts = np.flatnonzero(np.diff(row, prepend=-1))
                low = np.repeat(np.minimum.reduceat(inside["node"][i], cuts), np.diff(np.append(cuts, len(row))))
                i, j = place[i], place[j]
                hit[i] = hit[j] = True
                mine = part["node"][i] == low
                for x in (i[mine], j[mine]):
                    centre[x], fit[x] = low[mine], True
            yield pa.RecordBatch.from_arrays([pa.array(part["bucket"][hit]), pa.array(part["node"][hit]), pa.array(centre[hit], mask=~fit[hit]), pa.array(of[hit])], ["bucket", "node", "centre", "of"])

    return run


def _partners(words: int, percent: int, far_bits: int):
    """Rows (bucket, block, block) to (bucket, node): the nodes that may link with one of another component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            sides = [_members(batch.column(c), ["node"]) for c in (1, 2)]
            hits = [np.zeros(starts[-1], bool) for starts, _ in sides]
            for _, i, j in _fitting(batch, 1, 2, words, percent, far_bits):
                hits[0][i] = hits[1][j] = True
            for (starts, fields), hit in zip(sides, hits, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(buckets, np.diff(starts))[hit]), pa.array(fields["node"][hit])], ["bucket", "node"])

    return run


_PARTNERS = "bucket long, node long"


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists' sets, by products of incidence matrices."""
    sets = [*left, *right]
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    both = np.zeros((len(left), len(right)), np.int64)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    total = int(shared.sum())
    step = max(1, min(total, CELLS // len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, total, step):
        lo, hi = np.searchsorted(column, (at, at + step))
        grid = np.zeros((len(sets), step), np.float32)
        grid[row[lo:hi], column[lo:hi] - at] = 1
        both += (grid[: len(left)] @ grid[len(left) :].T).astype(np.int64)
    return both


def _linked_blocks(words: int, percent: int, far_bits: int, unpack: Sets):
    """Rows (block, block) to links across components, no more than join these components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            # Components that links of this batch have joined.
            parent: dict[int, int] = {}

            def find(x: int, parent: dict[int, int] = parent) -> int:
                while (up := parent.get(x, x)) != x:
                    x = up
                return x

            flat = [batch.column(c).flatten() for c in (0, 1)]
            nodes, parts = [f.field("node").to_numpy() for f in flat], [f.field("component").to_numpy() for f in flat]
            found = list(_fitting(batch, 0, 1, words, percent, far_bits))
            for at in range(0, len(found), GROUP):
                group = found[at : at + GROUP]
                # Each node's set is unpacked once for a group of rows.
                needed = [np.unique(np.concatenate([x[side] for x in group])) for side in (1, 2)]
                names, first = np.unique(np.concatenate([nodes[side][u] for side, u in enumerate(needed)]), return_index=True)
                texts = pa.concat_arrays([f.field("elements").take(pa.array(u)) for f, u in zip(flat, needed, strict=True)])
                sets = unpack(texts.take(pa.array(first)))
                places = [np.searchsorted(names, n[u]) for n, u in zip(nodes, needed, strict=True)]
                for _, i, j in group:
                    p, q = (place[np.searchsorted(u, x)] for place, u, x in zip(places, needed, (i, j), strict=True))
                    if len(p) > FEW:
                        (ua, ia), (ub, ib) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
                        shared = _overlaps([sets[k] for k in ua], [sets[k] for k in ub])[ia, ib].tolist()
                    for k, (x, y, c, d) in enumerate(zip(p.tolist(), q.tolist(), parts[0][i].tolist(), parts[1][j].tolist(), strict=True)):
                        if (c := find(c)) == (d := find(d)):
                            continue
                        both = shared[k] if len(p) > FEW else _shared(sets[x], sets[y])
                        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                            parent[max(c, d)] = min(c, d)
                            out.append((int(names[x]), int(names[y])))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return run


def _meetings(members: DataFrame, size: int, fields: list, work: Workspace, name: str) -> DataFrame:
    """(bucket, members, other_members): the blocks of about ``size`` members that a bucket's are dealt into, by
    pairs, but for pairs within one component.

    members: (bucket, salt, hot, node, component, fields).  A component of ``size`` members of a bucket, or
    more, has blocks of its own; the others share mixed blocks.  A hot bucket's members meet the counts by
    bucket and salt, so they lie in no task whole.
    """
    sizes = members.groupBy("bucket", "hot", "component").agg(F.count("*").alias("k"))
    large = sizes.where(F.col("k") >= size).select("bucket", "hot", "component", F.ceil(F.col("k") / size).alias("own_parts"))
    rest = sizes.where(F.col("k") < size).groupBy("bucket", "hot").agg(F.ceil(F.sum("k") / size).alias("mixed_parts"))
    groups = large.select("bucket", F.col("component").alias("own"), F.lit(False).alias("mixed"), F.col("own_parts").alias("parts"))
    groups = work.save(groups.unionByName(rest.select("bucket", F.lit(0).cast("long").alias("own"), F.lit(True).alias("mixed"), F.col("mixed_parts").alias("parts"))), f"{name}-groups")
    dealt = members.join(skew.repeated(large), ["bucket", "salt", "component"], "left").join(skew.repeated(rest), ["bucket", "salt"], "left").withColumn("mixed", F.col("own_parts").isNull())
    part = F.when(F.col("mixed"), F.pmod(F.xxhash64("component"), "mixed_parts")).otherwise(F.pmod(F.xxhash64("node"), "own_parts"))
    dealt = dealt.select("bucket", "mixed", F.when(F.col("mixed"), 0).otherwise(F.col("component")).alias("own"), part.alias("part"), F.struct("node", "component", *fields).alias("member"))
    blocks = work.save(dealt.groupBy("bucket", "mixed", "own", "part").agg(F.collect_list("member").alias("members")), name)
    x, y = (groups.select("bucket", *(F.col(c).alias(f"{c}_{i}") for c in ("own", "mixed", "parts"))) for i in (1, 2))
    same = F.col("mixed_1") & F.col("mixed_2")
    met = x.join(y, "bucket").where(same | (F.col("mixed_1") & ~F.col("mixed_2")) | (~F.col("mixed_1") & ~F.col("mixed_2") & (F.col("own_1") < F.col("own_2"))))
    met = met.withColumn("part_1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_1") - 1)))
    met = met.withColumn("part_2", F.explode(F.sequence(F.when(same, F.col("part_1")).otherwise(0).cast("long"), F.col("parts_2") - 1)))
    for i in (1, 2):
        side = blocks.select("bucket", *(F.col(c).alias(f"{c}_{i}") for c in ("mixed", "own", "part")), F.col("members").alias(f"members_{i}"))
        met = met.join(side, ["bucket", f"mixed_{i}", f"own_{i}", f"part_{i}"])
    return met.select("bucket", F.col("members_1").alias("members"), F.col("members_2").alias("other_members"))


def _hot_buckets(entries: DataFrame, total: int, work: Workspace) -> DataFrame | None:
    """(bucket) of the hot buckets, for a broadcast, or None: those of which a sample of the entries has more than
    half of what a hot one's would be.  It decides only where members meet, not whether."""
    least = max(skew.LEAST, total // skew.SHARE)
    share = min(1.0, 128 / least)
    some = entries if share == 1 else entries.sample(share, 7)
    counts = some.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    hot = work.save(counts.where(F.col("n") > least * share / 2).select("bucket"), "hot-buckets")
    return None if hot.isEmpty() else F.broadcast(hot)


def _pairs_a_member(left: DataFrame) -> float:
    """How many members of its bucket in other components a member has, on average."""
    by_component = left.groupBy("bucket", "component").agg(F.count("*").cast("double").alias("k"))
    by_bucket = by_component.groupBy("bucket").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("within"))
    n, across = by_bucket.agg(F.sum("n"), F.sum(F.col("n") * F.col("n") - F.col("within"))).first()
    return across / n if n else 0.0


def linked_components(
    entries: DataFrame, sketches: DataFrame, words: int, far_bits: int, percent: int, sets_of: Callable[[DataFrame], DataFrame], work: Workspace, unpack: Sets = stored_sets, release: Callable[[], None] | None = None, rows_per_batch: int = 16
) -> DataFrame:
    """(node, component) of every node with a link; component is the least node.

    Nodes that share a bucket are candidates; they link if their sets' Jaccard similarity
    is at least percent.  entries: (node, bands, n, s0 ...), a node's buckets, once or more.
    sketches: (node, n, s0 ...), the set's size, or 1 throughout if it isn't known, and
    ``words`` words of bits, the same in both; nodes whose sizes rule a link out, or that
    differ in over far_bits bits, are taken not to link.
    sets_of: a table of nodes to (node, elements), which ``unpack`` turns into arrays of
    sorted distinct hashes.  release is called once entries aren't needed any more.
    rows_per_batch: pairs of blocks, with their members' elements, that a task gets at once.

    One shuffle of the entries brings each bucket's members, with their sketches, into a task.
    Members of buckets of at most ``SKETCH_BLOCK`` whose sketches leave them no partner there
    go first.  Then each bucket's least node is paired with its other members, so pairs grow with
    the members.  Buckets whose members then lie in one component are done.  As long as the
    others' members have more than ``SKETCH_BLOCK`` members of other components beside them,
    on average, they are paired with other centres, ``TURNS`` times at most.  What is left is
    dealt into blocks by component, and blocks of different components are compared as
    matrices: first the sketches, then the sets of those that may link.

    A hot bucket (``skew``), which a sample of the entries shows, doesn't join that shuffle; it is
    split by salt: each part has a centre of its own, and the centres are paired with the least of them.  A centre's set goes out once for
    ``LEAVES`` pairs.
    """
    bits = [f"s{i}" for i in range(words)]
    each = entries.select(F.size("bands").alias("k")).first()
    total = entries.count() * each.k if each else 0
    entries = entries.select("node", "bands", F.col("n").cast("long").alias("n"), *bits)
    hot = _hot_buckets(entries, total, work)
    hot_ids = np.array([] if hot is None else [r.bucket for r in hot.collect()], np.int64)
    tasks = max(2 * entries.sparkSession.sparkContext.defaultParallelism, -(-total // ENTRIES))
    ranged = entries.mapInArrow(_by_range(words, RANGES * tasks, hot_ids), f"range int, {', '.join(f'{c} array<long>' for c in ('bucket', 'node', 'n', *bits))}")
    met = ranged.repartition(tasks, "range").mapInArrow(_bucket_partners(words, percent, far_bits), "bucket long, node long, centre long, of long")
    met = work.save(met, "partners", rows_per_batch=1 << 14)
    large = met.where(F.col("of") > SKETCH_BLOCK).select("bucket", F.lit(0).alias("salt"), F.lit(False).alias("hot"), "node")
    if hot is not None:
        salt = F.pmod(F.xxhash64("node"), F.lit(skew.SALTS)).cast("int")
        split = entries.select(F.explode("bands").alias("bucket"), "node").join(hot, "bucket", "left_semi").select("bucket", salt.alias("salt"), F.lit(True).alias("hot"), "node").distinct()
        large = large.unionByName(work.save(split, "members"))
    if release:
        release()
    sketched = sketches.select("node", F.col("n").alias("size"), *bits)
    fields = [F.col("size").alias("n"), *bits]
    partners = met.where(F.col("of") <= SKETCH_BLOCK)

    def centred(rows: DataFrame, turn: int) -> DataFrame:
        """(a, b): the pairs of each part's centre and its members, and of a hot bucket's centres."""
        rank = F.col("node") if not turn else F.xxhash64("node", F.lit(turn))
        centres = rows.groupBy("bucket", "salt", "hot").agg(F.min_by("node", rank).alias("centre"))
        heads = centres.where("hot").groupBy("bucket").agg(F.min("centre").alias("head"))
        stars = rows.join(centres.drop("hot"), ["bucket", "salt"]).select(F.col("centre").alias("a"), F.col("node").alias("b"))
        return stars.unionByName(centres.join(heads, "bucket").select(F.col("head").alias("a"), F.col("centre").alias("b")))

    def compared(pairs: DataFrame) -> DataFrame:
        """The distinct pairs whose sketches let them link."""
        pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.node")).join(sketches.alias("y"), F.col("b") == F.col("y.node"))
        n, m = F.col("x.n"), F.col("y.n")
        apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in bits), F.lit(0))
        return near.where((F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (apart <= far_bits)).select("a", "b")

    def confirmed(near: DataFrame, turn: int, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The pairs that link, and the sets, which stay if others are wanted: those of the nodes of also."""
        near = work.save(near, f"pairs-{turn}")
        nodes = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node")))
        sets = work.save(sets_of((nodes if also is None else nodes.unionByName(also)).distinct()), f"sets-{turn}")
        shares = near.groupBy("a").agg(F.ceil(F.count("*") / LEAVES).alias("shares"))
        dealt = near.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), "b")
        heads = shares.join(sets, shares.a == sets.node).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "elements")
        leaves = dealt.join(sets, dealt.b == sets.node).select("a", "share", "b", "elements")
        rows = heads.unionByName(leaves).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
        found = work.save(rows.mapInArrow(_confirmed(percent, unpack), "a long, b long"), f"links-{turn}")
        work.drop(f"pairs-{turn}", *([f"sets-{turn}"] if also is None else []))
        return found, sets

    def unfinished(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """The members of buckets that hold several components, with these."""
        labelled = work.save(rows.join(found, "node", "left").select("bucket", "salt", "hot", "node", F.coalesce("component", "node").alias("component")), f"{name}-all")
        several = labelled.groupBy("bucket", "hot").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        return work.save(labelled.join(skew.repeated(several.select("bucket", "hot")), ["bucket", "salt"], "left_semi"), name)

    tried = partners.where("centre != node").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    if not large.isEmpty():
        tried = tried.unionByName(compared(centred(large, 0)))
    links, sets = confirmed(tried.distinct(), 0, partners.where("of > 2").select("node"))
    found = connected_components(links, work, "components-0")
    left = unfinished(partners.where("of > 2").select("bucket", F.lit(0).alias("salt"), F.lit(False).alias("hot"), "node").unionByName(large), found, "left-0")
    work.drop("hot-buckets", "members", "partners", "left-0-all")
    turn = 0
    while turn < TURNS and _pairs_a_member(left) > SKETCH_BLOCK:
        turn += 1
        more, _ = confirmed(compared(centred(left.select("bucket", "salt", "hot", "node"), turn)), turn)
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        found = connected_components(links, work, f"components-{turn}")
        left = unfinished(left.drop("component"), found, f"left-{turn}")
        work.drop(*(f"left-{k}" for k in range(turn)), f"left-{turn}-all")

    if left.isEmpty():
        work.drop("sets-0")
        return found
    met = _meetings(left.join(sketched, "node"), SKETCH_BLOCK, fields, work, "sketch-blocks")
    near = work.save(met.mapInArrow(_partners(words, percent, far_bits), _PARTNERS).select("bucket", "node").distinct(), "near")
    # Sets of the first comparison serve again; only members of large buckets may lack theirs.
    nodes = near.select("node").distinct()
    lacking = work.save(nodes.join(sets.select("node"), "node", "left_anti"), "lacking")
    if not lacking.isEmpty():
        sets = sets.unionByName(sets_of(lacking))
    rows = left.join(near, ["bucket", "node"], "left_semi").join(sketched, "node").join(sets, "node")
    met = _meetings(work.save(rows, "partner-sets"), BLOCK, [*fields, "elements"], work, "blocks").select("members", "other_members")
    more = work.save(met.mapInArrow(_linked_blocks(words, percent, far_bits, unpack), "a long, b long"), "links-left", rows_per_batch=rows_per_batch)
    if not more.isEmpty():
        found = connected_components(links.unionByName(more), work, "components-left")
    work.drop(*(f"{name}-{k}" for k in range(turn + 1) for name in ("links", "left")), "sets-0", "lacking", "sketch-blocks", "sketch-blocks-groups", "near", "partner-sets", "blocks", "blocks-groups", "links-left")
    return found
