"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.sources.tables import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node it reaches through the edges given."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest in place of the part's edges, taken in blocks."""
    held, size, most = [], 0, 1_000_000

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            u, v = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= most:
            yield from out()
            held, size = [], 0
    yield from out()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if held:
        u, v = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        # a node that is the least of its component stands for itself
        top = np.unique(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, top])), pa.array(np.concatenate([v, top]))], ["u", "component"])


#: Edges that one task may finish: a checked bound, some 50 MB.
LOCAL_EDGES = 500_000


def components(edges: DataFrame, name: str = "components", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Nodes with the least node of their component: (u, component).

    edges: (u, v) of longs without nulls; direction, repeats and loops don't matter. Nodes without
    an edge to another have no row. Each part's edges are first replaced by a forest; then large-star
    and small-star steps alternate until nothing changes, which takes a number of rounds about
    logarithmic in the size. Every round is stored in the shared folder. Once local_edges or fewer are
    left, one task ends the work. No edges: no rows.
    """
    now = stored(edges.filter("u <> v").select("u", "v").mapInArrow(_contract, "u long, v long").distinct(), name)
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark[0] and mark[0] <= local_edges:
            return stored(now.coalesce(1).mapInArrow(_finish, "u long, component long"), name)
        if mark == seen or not mark[0]:
            return now.select("u", F.col("v").alias("component"))
        seen = mark
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = stored(small.filter("u <> v").distinct(), name)
