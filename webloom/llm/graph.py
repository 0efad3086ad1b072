"""Connected components; nothing is collected on the driver.

Up to ``LOCAL_EDGES`` edges one task joins them with union-find.  More edges go through alternating large-star and small-star
steps, which are joins and aggregations.  Both give the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, tidy

#: 16 MB of edges.
LOCAL_EDGES = 1_000_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of the component of each."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):  # parents come before their children
        parent[x] = parent[parent[x]]
    return nodes, nodes[parent] if len(nodes) else nodes


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        a, b = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (0, 1))
        node, root = union_find(a, b)
        under = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[under], pa.int64()), pa.array(root[under], pa.int64())], ["node", "root"])

    return edges.coalesce(1).mapInArrow(tidy(run), "node bigint, root bigint")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a bigint, b bigint)`` but the roots; root is the least node reachable."""
    edges = checkpointed(edges.where("a <> b").select("a", "b"))
    if edges.count() <= local_edges:
        return _in_one_task(edges)
    now, before = checkpointed(edges.distinct()), None
    while True:
        now = checkpointed(_small(_large(now)).where("a <> b").distinct())
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
