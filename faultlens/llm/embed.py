"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import stored
from faultlens.operators.components import components, forest

#: A pair at the threshold is missed by all tables with this probability at most.
MISS = 1e-5
#: Vectors wished for in a bucket; it sets the bits of a table.
BUCKET = 128
#: Vectors of a bucket compared at once; a larger bucket is taken in pairs of blocks, exactly.
BLOCK = 1500


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Bits per table and tables for n vectors."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / BUCKET))) if n > BUCKET else 4
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, tables * bits))


def codes(x: np.ndarray, normals: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A code per vector and table."""
    signs = (x @ normals >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range of doubles
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            out: list[list[int]] = [[] for _ in vectors]
            for dim in {len(v) for v in vectors}:
                own = [i for i, v in enumerate(vectors) if len(v) == dim]
                for i, row in zip(own, codes(_unit([vectors[i] for i in own]), planes(dim, bits, tables), bits, tables).tolist(), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["h", "codes"])

    return run


def _compare(bits: int, tables: int, cosine: float):
    """For each run of a bucket (or pair of its blocks): link counts of vectors, and a forest of the links.

    A pair that meets in several tables counts in the first only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list, list] = ([], [], [], [])
        normals: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out], ["h", "links", "u", "v"])
            for c in out:
                c.clear()
            return made

        def group(key: tuple, parts: list[list[np.ndarray]]) -> None:
            tab, _, dim, i, j = key
            h, rep, n, block, flat = (np.concatenate([p[k] for p in parts]) for k in range(5))
            x = _unit(flat.reshape(-1, dim))
            if dim not in normals:
                normals[dim] = planes(dim, bits, tables)
            own = codes(x, normals[dim], bits, tables)[:, :tab]
            first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
            near = x[first] @ x[second].T >= cosine
            if i == j:
                np.fill_diagonal(near, False)
            linked = near.copy()
            for t in range(tab):
                if not linked.any():
                    break
                linked &= own[first, t][:, None] != own[second, t][None, :]
            if not linked.any():
                return
            a, b = linked @ n[second], linked.T @ n[first]
            if i == j:
                b[:] = 0
            p, q = np.nonzero(np.triu(linked) if i == j else linked)
            u, v = forest(rep[first[p]], rep[second[q]])
            for at, got in ((first, a), (second, b)):
                if (some := got > 0).any():
                    out[0].append(h[at[some]])
                    out[1].append(got[some])
                    out[2].append(np.zeros(some.sum(), np.int64))
                    out[3].append(np.zeros(some.sum(), np.int64))
            out[0].append(np.zeros(len(u), np.int64))
            out[1].append(np.zeros(len(u), np.int64))
            out[2].append(u)
            out[3].append(v)

        key, held, done = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)]
            vectors = batch.column(9)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            ends = ends - ends[0]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in ints[:5]], axis=0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                now = tuple(int(c[lo]) for c in ints[:5])
                if now != key:
                    if sum(len(p[0]) for p in held) > 1:
                        group(key, held)
                    key, held = now, []
                held.append([*[c[lo:hi] for c in ints[5:]], flat[ends[lo] : ends[hi]]])
            done += batch.num_rows
            if done > 50_000:
                yield flush()
                done = 0
        if sum(len(p[0]) for p in held) > 1:
            group(key, held)
        yield flush()

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Every vector with its links and its component.

    vectors: vec_id, embedding. Result, a row per row: vec_id, n_links (other rows at the cosine or
    above), component_id, kept. Rows with one and the same vector are one node with a weight, so
    that their number costs nothing. A vector that is null, empty, zero or holds a null, NaN or
    infinity links with nothing, as vectors of different lengths do; it is its own component. Rows
    that repeat a vec_id are one node of the component graph. A null vec_id counts as a row of its
    vector, takes that vector's component and is never kept. Bits and tables follow the number of
    distinct vectors, so that a bucket keeps its size and a pair at the threshold is missed with
    probability MISS at most. Other columns are ignored.
    """
    # a vector of rows without a vec_id still is a node
    UNNAMED = F.expr("h & 2305843009213693951 | 4611686018427387904")  # noqa: N806
    e = F.col("embedding").cast("array<double>")
    good = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(embedding, c -> c <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long"), e.alias("embedding")).withColumn("good", F.coalesce(good, F.lit(False)))
    rows = stored(rows.withColumn("h", F.when(F.col("good"), F.xxhash64("embedding"))), "vectors")
    classes = stored(rows.filter("good").groupBy("h").agg(F.coalesce(F.min("vec_id"), UNNAMED).alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")), "classes")
    bits, tables = plan(classes.count(), cosine)
    coded = stored(classes.select("h", "embedding").mapInArrow(_hash(bits, tables), "h long, codes array<long>").select("h", F.posexplode("codes").alias("tab", "code")), "codes")
    sizes = coded.groupBy("tab", "code").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.filter(F.col("size") > BLOCK).select("tab", "code", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    some = sizes.filter("size > 1").select("tab", "code")
    placed = coded.join(some, ["tab", "code"]).join(large, ["tab", "code"], "left").join(classes, "h").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks")).cast("int"))
    meet = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, block) as i, greatest(k, block) as j))")
    placed = placed.withColumn("meet", F.explode(meet)).select("tab", "code", F.size("embedding").alias("dim"), "meet.i", "meet.j", "h", "rep", "n", "block", "embedding")
    keys = ["tab", "code", "dim", "i", "j"]
    found = stored(placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(bits, tables, cosine), "h long, links long, u long, v long"), "found")
    counts = found.filter("links > 0").groupBy("h").agg(F.sum("links").alias("links"))
    # a repeated vec_id ties its vectors together
    same = rows.filter("good and vec_id is not null").join(classes.select("h", "rep"), "h").groupBy("vec_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u <> v").select("u", "v")
    parts = components(found.filter("u <> v").select("u", "v").unionByName(same))
    info = classes.select("h", "rep", "n").join(parts.withColumnRenamed("u", "rep"), "rep", "left").join(counts, "h", "left")
    info = info.select("h", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("found"))
    out = rows.select("vec_id", "h").join(info, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("found"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
