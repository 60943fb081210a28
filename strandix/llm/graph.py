"""Connected components of an edge table, by contraction within chunks and alternating stars (Kiveris et al., 2014), cut into written tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK = 1 << 20  # edges that a task contracts at a time, and that a file of edges holds


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of some edges but the roots; the root is the smallest node that these edges reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:  # hooks roots to smaller roots, then shortens all paths
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := up[up], up):
            up = nxt
    moved = up != np.arange(len(nodes))
    return nodes[moved], nodes[up[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """The edges (u, v) of each task's chunks as stars about the smallest nodes that a chunk connects."""

    def run(batches):
        u, v, n = [], [], 0

        def out():
            a, b = contract(np.concatenate(u), np.concatenate(v))
            for at in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], names=["u", "v"])

        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= CHUNK:
                yield from out()
                u, v, n = [], [], 0
        if n:
            yield from out()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), two long columns; the root is the component's smallest node.

    Each round contracts the edges in chunks, which settles most of a graph, and all of one that fits in a chunk. Between chunks, every node
    sends its larger neighbours, then its smaller ones, to the smallest node it knows. A node's smallest neighbour is an
    aggregate with partial sums, so a node with many neighbours is no hot key there; the joins that follow can be split by
    adaptive execution. Rounds go on until nothing changes.
    """
    n = None
    rows = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(rows, "edges")
    before = _state(edges)
    while before[0] and before != n:
        n = before
        edges = written(contracted(edges.coalesce(max(1, before[0] // CHUNK))), "edges")
        before = _state(edges)
        if n[0] <= CHUNK:  # one chunk held them all
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        before = _state(edges)
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
