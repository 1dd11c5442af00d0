"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation and a join on the edge table by its ends: rows stream through, but those of one end meet in a
task, so at the last steps a large component's edges do, at their root. The number of steps grows with the logarithm of the graph (Kiveris et al., "Connected components in
MapReduce and beyond", 2014). The table is written after each round, which cuts the lineage. A counted table of at most
``SMALL`` edges (3 MB) is settled by one task with union-find instead, which gives the same in one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.scratch import stage


SMALL = 200_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges to (node, root), roots being the least nodes."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while (above := parent.get(node, node)) != node:
            parent[node] = parent.get(above, above)
            node = above
        return node

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = sorted(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], names=["node", "root"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour (or the node itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. ``edges`` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: longs) that isn't the least of its component."""
    current = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = _state(current)
    if before[0] <= small:
        return current.coalesce(1).mapInArrow(_union_find, "node long, root long")
    while before[0]:
        current = stage(_small_star(_large_star(current)), "edges")
        now = _state(current)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
