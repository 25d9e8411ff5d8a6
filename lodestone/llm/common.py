"""What several corpus operators share: words, scratch tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import discard, materialize, scratch_path

__all__ = ["HEAVY_LEAST", "HEAVY_NODES", "WORD_PATTERN", "connected_components", "discard", "in_pieces", "join_skewed", "local_roots", "materialize", "scratch_path", "trim_memory"]

#: The separators of words in every word-based operator here: space and the ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A node is heavy from so many edges on, or from this share of all edges; there are at most twice HEAVY_NODES of them.
HEAVY_LEAST, HEAVY_NODES = 256, 4_000
#: Edges (16 bytes each) from which least neighbours are joined by shuffle, not broadcast.
BROADCAST_NODES = 200_000
#: Edges that a contraction task takes, and the least number of its tasks.
TASK_EDGES, LEAST_TASKS = 100_000, 8


def trim_memory() -> None:
    """Hand memory that Arrow and the allocator hold but don't use back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that what is worked out for one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def join_skewed(rows: DataFrame, keyed: DataFrame, on: list[str], heavy: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left_semi) with ``keyed``, which has each key once; rows of its ``heavy`` keys, a bounded number, are joined by broadcast and stay where they are."""
    hot = F.broadcast(keyed.where(heavy))
    cold = rows.join(hot.select(*on), on, "left_anti").join(keyed.where(~heavy), on, how)
    return rows.join(hot, on, how).unionByName(cold)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' components under the edges (a[i], b[i]); vectorised label propagation with pointer jumping."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(root, before):
            return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars: every node points at the least node that the partition's edges connect it with, once."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        u, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = local_roots(len(nodes), at[: len(u)], at[len(u) :])
        off = np.flatnonzero(root != np.arange(len(nodes)))
        for k in range(0, len(off), 100_000):
            x = off[k : k + 100_000]
            yield pa.RecordBatch.from_pydict({"u": nodes[x], "v": nodes[root[x]]})


def _stamped(df: DataFrame) -> tuple[DataFrame, tuple]:
    """``df`` (u, v) as a table, with its size and a hash of its rows, observed while it is written."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")), "edges")
    return out, (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (longs); the component is its smallest node.

    Rounds of a large-star step (an edge's smaller end is replaced by that end's least neighbour) and a contraction of
    each partition, dealt by the larger end, into stars, until nothing changes. A partition names a node once, so the
    number of partitions bounds a node's edges to smaller ones; popular smaller ends are joined by broadcast. Every round's
    edges are a table in the shared folder. Self loops and repeated edges are ignored; an empty input gives an empty result.
    """

    def dealt(e: DataFrame, n: int) -> DataFrame:
        # Few edges need few tasks; partitions are put together whole, so a node's edges stay in one.
        return e.repartition("u").coalesce(max(LEAST_TASKS, n // TASK_EDGES)).mapInArrow(_contract, "u long, v long")

    def lifted(e: DataFrame, n: int) -> DataFrame:
        low = e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("low"))
        to = F.coalesce("low", "v").alias("v")
        if n <= BROADCAST_NODES:
            return e.join(F.broadcast(low), F.col("v") == F.col("w"), "left").select("u", to)
        hot = e.groupBy("v").count().where(F.col("count") > max(HEAVY_LEAST, n // HEAVY_NODES)).select(F.col("v").alias("h"))
        hot = F.broadcast(materialize(hot.join(low, F.col("h") == F.col("w"), "left").select("h", "low"), "hot"))
        cold = e.join(hot, F.col("v") == F.col("h"), "left_anti").join(low, F.col("v") == F.col("w"), "left").select("u", to)
        return e.join(hot, F.col("v") == F.col("h")).select("u", to).unionByName(cold)

    ends = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e, seen = _stamped(dealt(ends.mapInArrow(_contract, "u long, v long"), edges.count()))
    while seen[0]:
        nxt, now = _stamped(dealt(lifted(e, seen[0]), seen[0]))
        discard(e)
        e = nxt
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
