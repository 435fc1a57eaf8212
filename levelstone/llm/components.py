"""Connected components of an edge table, without collecting anything to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released

_EDGE = "a long, b long"
#: Edges of which one task makes the whole forest, within its memory; more are solved by steps over all tasks.
LOCAL = 500_000


def _forest(batches):
    """Spanning forest of a task's edges: each node once, with the smallest node that the task's edges tie it to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def flush():
        nodes = list(parent)
        roots = [find(x) for x in nodes]
        keep = [(r, x) for r, x in zip(roots, nodes) if r != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # memory stays bounded; several forests of one task are as good as one
            yield flush()
    yield flush()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of ``edges(a, b)`` with ``component``, the smallest node reachable.

    Up to ``LOCAL`` edges, one task's forest is the answer. More go through large-star and small-star steps in turn, each a
    map-side combined minimum and a join on the node, until the edges form stars. Each step's edges are written to the
    shared folder. No edges: an empty result.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and a < b")
    # a forest within each task comes after a shuffle: one Python worker for each core, whatever the edges come from
    now = scratch.save(edges.distinct().mapInArrow(released(_forest), _EDGE).distinct(), "forest")
    if now.limit(LOCAL + 1).count() <= LOCAL:
        stars = scratch.save(now.coalesce(1).mapInArrow(released(_forest), _EDGE), "stars")
        scratch.drop(now)
        roots = stars.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
        return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = scratch.save(large.where("a < b").distinct().mapInArrow(released(_forest), _EDGE).distinct(), "large")
        scratch.drop(now)
        parents = scratch.save(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")), "parents")
        # stars: every node has one parent, and no parent has one itself
        inner = parents.where("n > 1").select(F.col("b").alias("x")).unionByName(large.select(F.col("a").alias("x")).join(large.select(F.col("b").alias("x")), "x", "left_semi"))
        if not inner.limit(1).count():
            out = parents.select(F.col("b").alias("node"), F.col("m").alias("component"))
            roots = out.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
            done = scratch.save(out.unionByName(roots), "components")
            scratch.drop(large, parents)
            return done
        small = large.join(parents, "b").select("a", "b", "m")
        small = small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(parents.select(F.col("m").alias("a"), "b"))
        now = scratch.save(small.where("a < b").distinct().mapInArrow(released(_forest), _EDGE).distinct(), "small")
        scratch.drop(large, parents)
