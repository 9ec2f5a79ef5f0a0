"""Distributed union-find: connected components of a DataFrame of edges.

Few edges (their number is checked) are joined by one task, from and to the shared folder.  Beyond
that, large-star and small-star steps alternate (Kiveris et al., "Connected Components in MapReduce
and Beyond"): each step is an aggregation and a join, halves the depth of the trees and never
gathers a component in a task; each round's edges go to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_enough

#: Edges that one task may join: 16 bytes each.
FEW = 200_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find of all edges of a task, the smaller root winning."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], names=["id", "root"])


def components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(id, root) of every id with an edge: root is the smallest id reachable. edges: (a long, b long), either way round; self-loops count for nothing."""
    x = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if small_enough(x, few):
        return x.coalesce(1).mapInArrow(_joined, "id long, root long")
    state = None
    for _ in range(rounds):
        now = x.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state or not now[0]:
            break
        state = now
        x = cut(_small(_large(x)))
    return x.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(x.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
