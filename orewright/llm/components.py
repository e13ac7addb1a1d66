"""Connected components over a distributed edge list (large-star / small-star rounds of Spark joins).

Each round is two minimum aggregations (combined before the shuffle) and two joins. A hub node is never gathered into one
task: the aggregation ships one row a task for it, and is written before it is joined, so that the join has nothing but
exchanges under it and its rows can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, Scratch, tidy

_BLOCK = 1 << 20


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each block of edges: same components, at most one edge a node."""

    def forest(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        high, low = Forest(np.arange(len(nodes))).link(at[: len(u)], at[len(u) :])
        return pa.RecordBatch.from_arrays([pa.array(nodes[high]), pa.array(nodes[low])], names=["u", "v"])

    us, vs, held = [], [], 0
    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= _BLOCK:
            yield forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [], [], 0
    if held:
        yield forest(np.concatenate(us), np.concatenate(vs))


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("x", "y")
    least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m"))
    least = scratch.save(least)
    return both.where("y > x").join(least, F.col("x") == F.col("k")).select(F.col("y").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    least = scratch.save(least)
    moved = edges.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of a bounded edge list in one task."""
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = Forest(np.arange(len(nodes)))
        forest.link(at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest.labels])], names=["node", "root"])


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60, block: int = _BLOCK) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: not-null longs); root is the smallest node reachable.

    An empty edge list gives an empty table. Repeated edges and self-loops change nothing. Once a spanning forest of each
    task's edges leaves no more than ``_BLOCK`` (16 MB), one task unites them; rounds of joins go on until then.
    """
    state = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_thin, "u long, v long"))
    seen: tuple | None = None
    for _ in range(rounds):
        now = tuple(state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now[0] <= block:
            return state.coalesce(1).mapInArrow(tidy(_rooted), "node long, root long")
        if now == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v"), F.col("v"))).distinct()
        seen = now
        with scratch.passing():
            large = scratch.save(_large_star(state, scratch).distinct())
            nxt = scratch.save(_small_star(large, scratch).distinct())
            scratch.keep(nxt)
        scratch.drop(state)
        state = nxt
    raise RuntimeError(f"components did not settle in {rounds} rounds")
