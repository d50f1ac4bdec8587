"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm import frames
from corpusgauge.session import stored

MAX_ROUNDS = 60
#: Edges that a task holds at once to contract them.
CHUNK = 1 << 18


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node of its component in the graph of these edges."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        if (low == high).all():
            break
        # tops are hung below lesser tops, then every node below its top
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    below = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[below], nodes[parent[below]]


def contracted(edges: DataFrame) -> DataFrame:
    """Stars with the same components as ``edges(a, b)``, made in each task, ``CHUNK`` edges at a time."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= CHUNK:
                yield _contracted(held)
                held = []
        if held:
            yield _contracted(held)

    return frames.map_batches(edges.select("a", "b"), contract, "a BIGINT, b BIGINT")


def _contracted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    ends = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("a", "b")]
    return pa.record_batch([pa.array(e, pa.int64()) for e in stars_of(*ends)], names=["a", "b"])


def _are_stars(edges: DataFrame) -> bool:
    """True when every node has edges down to one node, or only edges from above."""
    up = F.struct(F.col("b").alias("a"), F.lit(None).cast("long").alias("down"))
    ends = edges.select(F.explode(F.array(F.struct("a", F.col("b").alias("down")), up)).alias("e"))
    nodes = ends.groupBy("e.a").agg(
        F.min("e.down").alias("lo"), F.max("e.down").alias("hi"), F.max(F.col("e.down").isNull()).alias("above")
    )
    return nodes.filter("lo <> hi OR (lo IS NOT NULL AND above)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``; the root is the least node.

    Tasks first make stars of the edges they have at hand, ``CHUNK`` at a time, which
    needs no shuffle; so does every round with the table it reads.  Each round links every node to the least of its neighbours, larger ones first, then
    the smaller ones; the number of rounds grows with the logarithm of a component's
    size.  Only edges are moved, never collected, and each round is written, so that a
    lost executor costs one round at most.  Minima are combined before the shuffle, so
    a node with very many edges is no burden to one task.
    """
    now = stored(contracted(stored(contracted(edges), "edges")), "edges")
    for _ in range(MAX_ROUNDS):
        if _are_stars(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b")
        # now all edges go down: a > b
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("n")).filter("b <> m")
        small = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = small.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        # few files of a small table make a task of their own
        now = stored(contracted(stored(now, "edges")), "edges")
    else:
        raise RuntimeError(f"components: no end after {MAX_ROUNDS} rounds")
    named = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))
    return now.select(F.explode(named).alias("e")).select("e.*").distinct()
