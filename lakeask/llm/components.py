"""Distributed connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, scratch, stage


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges that are not the smallest of their component, and that smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            x, parent[x] = parent.get(x, x), root
        return root

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    return np.array(nodes, np.int64), np.array([find(x) for x in nodes], np.int64)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by stars: at most one edge for each node."""
    us, vs, held = [], [], 0
    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held > 1 << 20:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
    if us:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def connected_components(edges: DataFrame, single_task_edges: int = 1 << 19, contracted: bool = False) -> DataFrame:
    """(node, root) for every node of `edges` (columns u, v, long) that is not the smallest of its component.

    Each partition first shrinks its edges to stars, unless they come `contracted` from a Python step, so that no task needs
    two workers. If at most `single_task_edges` remain - a checked bound - one task
    ends it; else large-star and small-star rounds run as joins and aggregates until nothing changes. Self links, nulls,
    repeated edges and an empty table are fine; nodes without a row are their own root.
    """
    edges = edges.filter("u is not null and v is not null and u <> v")
    edges = stage(edges if contracted else edges.mapInArrow(_contract, "u long, v long"), "edges")
    if edges.count() <= single_task_edges:
        return edges.coalesce(1).mapInArrow(_contract, "u long, v long").toDF("node", "root")
    before = None
    while True:
        last = edges
        with scratch(edges.sparkSession):
            both = edges.union(edges.select("v", "u"))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = stage(large.filter("u <> v").distinct(), "large")
            down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            edges = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small", keep=True)
        discard(last)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.toDF("node", "root")
        before = after
