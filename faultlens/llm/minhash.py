"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A tree of the forest orders all documents by a sequence of MinHash values. Neighbours in an order
that share a long enough prefix are candidates, as are a document and the first document of each
region (run of equal prefix) it lies in, at each depth the region reaches: a crowded region has more
first documents, deeper down, a sparse one only few. A second round compares across what the first
left apart, in blocks and exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import WordHashes, mixed, portions, stored, words_of
from faultlens.operators.components import components

#: Share of pairs at the threshold that no tree may bring together.
MISS = 1e-6
#: Least depth of a candidate region, at most; levels below it that crowded regions are parted by.
LEAST, MORE = 4, 3
#: Digests of a block of documents that the second round compares at once.
BLOCK = 400_000
SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, sig binary"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter that spares the second reading of documents most of its rows; a fixed size, false positives do no harm.
FILTER_BITS = 1 << 23


def shingles(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit digests of the word windows; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    h, k = hashes.array(words), min(width, len(words))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        x = np.full(n, k, np.uint64)
        for j in range(k):
            x = x * BASE + h[j : j + n]
    return np.unique(mixed(x))


class Shape(NamedTuple):
    """Trees of a forest, MinHash values of an order, and the shortest shared prefix of a candidate pair."""

    trees: int
    depth: int
    least: int

    @classmethod
    def of(cls, percent: int) -> Shape:
        """The forest for a threshold: one with a Jaccard of s shares `least` values in a tree with probability s ** least, so that all trees miss it with (1 - s ** least) ** trees <= MISS."""
        if not 40 <= percent <= 100:
            raise ValueError("percent: from 40 to 100")
        s = percent / 100
        least = LEAST if s == 1 else min(LEAST, max(1, int(math.log(0.4) / math.log(s))))
        return cls(1 if s == 1 else math.ceil(math.log(MISS) / math.log(1 - s**least)), least + MORE, least)


def _sign(width: int, shape: Shape):
    rng = np.random.Generator(np.random.PCG64(20240229))
    values = shape.trees * shape.depth
    mul = (rng.integers(0, 1 << 32, values, np.uint64) | np.uint64(1)).astype(np.uint32)
    add = rng.integers(0, 1 << 32, values, np.uint64).astype(np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for lo, hi in portions(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                sets = [shingles(words_of(t), hashes, width) for t in part.column(1).to_pylist()]
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                sig = [None] * len(sets)
                h1, h2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    with np.errstate(over="ignore"):
                        h1[full] = np.add.reduceat(mixed(flat + BASE), starts).view(np.int64)
                        h2[full] = np.bitwise_xor.reduceat(mixed(flat * BASE + np.uint64(1)), starts).view(np.int64)
                        x = (flat >> np.uint64(32)).astype(np.uint32)
                        low = np.empty((len(full), values), ">u4")
                        for k in range(values):
                            low[:, k] = np.minimum.reduceat(x * mul[k] + add[k], starts)
                    for i, row in zip(full, low, strict=True):
                        sig[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return sign


def signatures(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, set size, a 128-bit digest of the set (h1, h2) and the signature (null for an empty set)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sign(width, Shape.of(percent)), SIGNATURE)


def _sweep(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """Over sorted (tree, label, rep): pairs of neighbours and of members with the first of their regions, and the part's ends."""
    last: tuple | None = None
    depth, least = shape.depth, shape.least
    pivots: list[int] = [0] * (depth + 1)
    for batch in batches:
        a, b = [], []
        ends = [] if last else [(batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), batch.column(2)[0].as_py())]
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            tree, label, rep = row
            shared = 0
            if last and last[0] == tree:
                other = last[1]
                while shared < depth and label[4 * shared : 4 * shared + 4] == other[4 * shared : 4 * shared + 4]:
                    shared += 1
            if shared >= least:
                for p in {last[2], *pivots[least : shared + 1]}:
                    if p != rep:
                        a.append(p)
                        b.append(rep)
            for d in range(shared + 1, depth + 1):
                pivots[d] = rep
            last = row
        n = len(a)
        yield pa.RecordBatch.from_arrays([pa.array([*a, *(e[2] for e in ends)], pa.int64()), pa.array([*b, *(e[2] for e in ends)], pa.int64()), pa.array([None] * n + [e[0] for e in ends], pa.int32()), pa.array([None] * n + [e[1] for e in ends], pa.binary())], ["a", "b", "tree", "label"])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([last[2]], pa.int64()), pa.array([last[2]], pa.int64()), pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.binary())], ["a", "b", "tree", "label"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def forest_orders(classes: DataFrame, shape: Shape) -> DataFrame:
    """(tree, label, rep) for each tree of the forest."""
    labels = F.array(*[F.expr(f"substring(sig, {1 + 4 * shape.depth * t}, {4 * shape.depth})") for t in range(shape.trees)])
    return classes.select("rep", F.posexplode(labels).alias("tree", "label")).select("tree", "label", "rep")


def first_candidates(classes: DataFrame, shape: Shape) -> DataFrame:
    """(a, b): neighbours with a shared prefix in some order, however the orders are cut into parts."""
    order = forest_orders(classes, shape)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sweep(batches, shape)

    swept = stored(order.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep").mapInArrow(neighbours, "a long, b long, tree int, label binary"), "neighbours")
    # two rows for each part: where one order goes on in the next part
    ends = swept.filter("tree is not null").select("tree", "label", F.col("a").alias("rep")).repartition(1).sortWithinPartitions("tree", "label", "rep").mapInArrow(neighbours, "a long, b long, tree int, label binary")
    return _ordered(swept.filter("tree is null").unionByName(ends.filter("tree is null")).select("a", "b"))


class Joined:
    """Components that this task's links have joined so far."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, c: int) -> int:
        up = self.up
        while (p := up.get(c, c)) != c:
            up[c] = up.get(p, p)
            c = p
        return c


def _confirm(percent: int):
    """Over (a, b, set of a, set of b): the links found, as (u, v); a pair that links of this task join already is passed over."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Joined()
        for batch in batches:
            u, v = [], []
            xs, ys = batch.column(2), batch.column(3)
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                p, q = np.frombuffer(xs[k].as_buffer(), np.uint64), np.frombuffer(ys[k].as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)) or (ra := known.root(a)) == (rb := known.root(b)):
                    continue
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                if 100 * both >= percent * (len(p) + len(q) - both):
                    known.up[ra] = rb
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return confirm


def _involved(pairs: DataFrame, width: int):
    """The column a bit table of fixed size is asked with, and a map of (id, text, bit) to the full sets of ids that may be in a pair."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    rows = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in rows:  # at most FILTER_BITS / 64 rows
        bits[r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            found = batch.filter(pa.array(hit.astype(bool)))
            for lo, hi in portions(found.column(1)):
                part = found.slice(lo, hi - lo)
                full = [shingles(words_of(t), hashes, width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in full], pa.int64()), pa.array([x.tobytes() for x in full], pa.binary())], ["id", "n", "full"])

    return bit, keep


def candidate_sets(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(id, n, full): the full sets of all documents in a pair, made anew from their texts."""
    bit, keep = _involved(pairs, width)
    sets = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).withColumn("bit", bit).mapInArrow(keep, "id long, n long, full binary")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return stored(sets.join(needed, "id", "left_semi"), "sets")


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs, as (u, v), whose full sets have 100 * intersection >= percent * union, but for such as join nothing new."""
    side = lambda s, f: sets.select(F.col("id").alias(s), F.col("full").alias(f))
    met = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y")
    return stored(met.mapInArrow(_confirm(percent), "u long, v long"), "links")


def _across(percent: int):
    """Over (cluster, i, j, few, id, component, full), sorted: links between the few and the others of each block.

    The others' digests are merged into one sorted list, in which each of the few finds all its
    intersections at once.
    """

    def block(rows: list[tuple], known: Joined, u: list[int], v: list[int]) -> None:
        few = [r for r in rows if r[0]]
        rest = [r for r in rows if not r[0]]
        if not few or not rest:
            return
        sets = [np.frombuffer(r[3], np.uint64) for r in rest]
        size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(rest)), size)[order]
        for _, a, ca, full in few:
            p = np.frombuffer(full, np.uint64)
            lo, hi = np.searchsorted(flat, p, "left"), np.searchsorted(flat, p, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(rest))
            for k in np.flatnonzero(100 * both >= percent * (len(p) + size - both)).tolist():
                ra, rb = known.root(ca), known.root(rest[k][2])
                if ra != rb:
                    known.up[ra] = rb
                    u.append(a)
                    v.append(rest[k][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, held = Joined(), None, []
        u: list[int] = []
        v: list[int] = []
        for batch in batches:
            for lo, hi in portions(batch.column(batch.num_columns - 1), 8_000_000):
                for row in zip(*[c.slice(lo, hi - lo).to_pylist() for c in batch.columns], strict=True):
                    if row[:3] != key:
                        block(held, known, u, v)
                        key, held = row[:3], []
                    held.append(row[3:])
        block(held, known, u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def second_links(sets: DataFrame, pairs: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between components that lie in one cluster, a component of the candidate pairs.

    All members of a region are candidates one after the other, so a cluster holds whole regions. In
    a cluster, members of its largest component are not compared with each other again; each of the
    few others meets every member, in blocks of at most BLOCK digests, and nothing is put out but
    links that join components. So the work is exact and its output never more than the members.
    """
    label = lambda edges, name: components(edges, name).select(F.col("u").alias("id"), F.col("component").alias(name))
    nodes = sets.groupBy("id").agg(F.max("n").alias("n")).join(label(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), "cluster"), "id", "left").join(label(links, "part"), "id", "left")
    nodes = stored(nodes.select("id", "n", F.coalesce("cluster", "id").alias("cluster"), F.coalesce("part", "id").alias("part")), "nodes")
    per = nodes.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    split = per.groupBy("cluster").agg(F.count(F.lit(1)).alias("parts"), F.max_by(F.struct("part", "n"), F.struct("k", "part")).alias("most"), F.sum("n").alias("n")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    split = split.select("cluster", F.col("most.part").alias("largest"), blocks(F.col("n")).alias("all"), blocks(F.col("n") - F.col("most.n")).alias("few"))
    met = stored(nodes.join(split, "cluster"), "split")
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = met.select("cluster", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), place(1, "all").alias("j"), F.lit(False).alias("is_few"), "id", "part")
    some = met.filter("part <> largest").select("cluster", place(2, "few").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.lit(True).alias("is_few"), "id", "part")
    rows = every.unionByName(some).join(sets.select("id", "full"), "id").select("cluster", "i", "j", "is_few", "id", "part", "full")
    return stored(rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_across(percent), "u long, v long"), "links")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """Every document with its component of near copies.

    docs: doc_id, text. percent: from 40 to 100; the forest's trees and depths follow from it. Result, a
    row per row of docs: doc_id, n_shingles (set size), component_id (smallest doc_id reachable over links, itself included), kept (doc_id = component_id).
    Documents of one set are one node, whatever their number. Null or wordless texts have an empty
    set and link with nothing. Rows that repeat a doc_id are one node. A null doc_id takes its set's
    component and is never kept. An empty table gives no rows; other columns are ignored.
    """
    shape = Shape.of(percent)
    signed = stored(signatures(docs, width, percent), "signatures")
    sets = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(sets.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "classes")
    pairs = stored(first_candidates(classes, shape), "pairs")
    full = candidate_sets(docs, pairs, width)
    links = confirmed(full, pairs, percent)
    links = links.unionByName(second_links(full, pairs, links, percent))
    # rows that repeat a doc_id with other texts tie their sets together
    same = sets.join(classes.select("h1", "h2", "n_shingles", "rep"), ["h1", "h2", "n_shingles"]).groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u <> v").select("u", "v")
    parts = components(links.unionByName(same))
    classes = classes.select("h1", "h2", "n_shingles", "rep").join(parts.withColumnRenamed("u", "rep"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("found"))
    out = signed.join(classes, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
