"""Connected components of a link table, by distributed union-find.

Each partition first contracts its links with a local union-find.  Alternating
large-star and small-star passes (Kiveris et al. 2014) then hook every node to
the least node it knows until only stars are left.  Minima are pre-aggregated
before their shuffle, and the links of a hot node (``skew``) meet its minimum by
salt, so a node with very many links reaches no task whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew
from .workspace import Workspace

#: Links that a partition's union-find holds before it hands out its forest.
LOCAL_LINKS = 1 << 19


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a partition to a forest (u, v) with the same components, v < u."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def forest() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])

    seen = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        seen += len(batch)
        if seen >= LOCAL_LINKS:
            yield forest()
            seen = 0
    yield forest()


def _met(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(u, v, m): links (u, v) with their node's minimum of (u, m, links), of ``total`` links at most."""
    hot = skew.hot_keys(least, "u", "links", total) if total > skew.LEAST else None
    return skew.joined(rows, least.select("u", "m"), "u", hot, "v")


def connected_components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, component) of every node that has a link; component is the least node reachable.

    links: two long columns.  Rows with a null are no links; repeats, loops and
    either direction are allowed; an empty table gives an empty result.
    """
    a, b = links.columns[:2]
    clean = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    # As many tasks as hold all links, each as many as its union-find may hold.
    total = clean.count()
    tasks = -(-max(1, total) // LOCAL_LINKS)
    edges = work.save(clean.coalesce(tasks).mapInArrow(contract, "u long, v long").distinct(), f"{name}-0")
    step = 0
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("as_child"), F.lit(0).alias("as_root"))
        ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("as_child"), F.lit(1).alias("as_root")))
        ends = ends.groupBy("node").agg(F.sum("as_child").alias("ups"), F.max("as_root").alias("as_root"))
        if ends.where("ups > 1 or (ups = 1 and as_root = 1)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")).select("u", F.least("u", "m").alias("m"), "links")
        large = _met(both.where("v > u"), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if total > skew.LEAST:
            large = work.save(large, f"{name}-large-{step}")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links"))
        small = _met(large, low, 2 * total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = work.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step + 1}")
        work.drop(f"{name}-{step}", f"{name}-large-{step}")
        edges, step = after, step + 1
    child = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return child.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
