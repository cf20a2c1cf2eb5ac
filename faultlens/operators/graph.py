"""Netlist graphs: edges, degrees, components, adjacency weights, k-hop propagation, features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType
from pyspark.sql.window import Window

from faultlens.functions.scalar import edge_role
from faultlens.operators.components import components
from faultlens.sources.tables import stored

ROLES = ("DATA", "SELECT", "ENABLE", "CLOCK", "RESET", "OTHER")


def classify_branches(pins: DataFrame, drivers: DataFrame, inputs: DataFrame) -> DataFrame:
    """Each input pin's branch with its source: INTERNAL, TOP_INPUT, CONSTANT or UNDRIVEN.

    pins: (cell, cell_type, port, pin, kind, bit, dst); drivers: (bit, src), unique by bit; inputs:
    (bit, source_name, source_pin). A pin on several top inputs has a row for each.
    """
    met = pins.join(drivers, "bit", "left").join(inputs, "bit", "left")
    source = F.when(F.col("kind") == "constant", "CONSTANT").when(F.col("src").isNotNull(), "INTERNAL").when(F.col("source_name").isNotNull(), "TOP_INPUT").otherwise("UNDRIVEN")
    out = met.withColumn("source_kind", source).withColumn("role", edge_role(F.col("cell_type"), F.col("port")))
    # an internally driven pin counts once, however many names its bit has
    names = Window.partitionBy("cell", "port", "pin").orderBy("source_name", "source_pin")
    return out.withColumn("_k", F.row_number().over(names)).filter("_k = 1 or source_kind = 'TOP_INPUT'").drop("_k")


def branch_accounting(branches: DataFrame) -> DataFrame:
    return branches.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("source_kind") == k).alias(k.lower()) for k in ("INTERNAL", "TOP_INPUT", "CONSTANT", "UNDRIVEN")])


def collapse(branches: DataFrame, roles: Sequence[str] = ROLES, src: str = "src", dst: str = "dst", role: str = "role") -> DataFrame:
    """Parallel branches as one edge: multiplicity, branches per role, self-loop flag."""
    sums = [F.count_if(F.col(role) == r).alias(f"{r.lower()}_branches") for r in roles]
    out = branches.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count(F.lit(1)).alias("multiplicity"), *sums)
    return out.withColumn("is_self_loop", (F.col("src") == F.col("dst")).cast("int"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Branches and distinct neighbours, in and out, per node; nodes without edges have zeros.

    One shuffle: each edge gives a row to either end.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("o_in"), F.lit(1).alias("o_out"), "multiplicity"), F.struct(F.col("dst").alias("node"), F.lit(1).alias("o_in"), F.lit(0).alias("o_out"), "multiplicity"))).alias("e")).select("e.*")
    got = ends.groupBy("node").agg(*[F.sum(F.col(f"o_{d}") * F.col("multiplicity")).alias(f"{d}_degree_branches") for d in ("in", "out")], *[F.sum(f"o_{d}").cast("long").alias(f"{d}_neighbor_count") for d in ("in", "out")])
    if nodes is None:
        return got
    names = [c for c in got.columns if c != "node"]
    return nodes.select("node").distinct().join(got, "node", "left").fillna(0, names)


def adjacency(edges: DataFrame, nodes: DataFrame, direction: str) -> DataFrame:
    """Row-normalised weights with a self-loop of weight 1 on every node: (node, other, weight)."""
    a, b = ("dst", "src") if direction == "inbound" else ("src", "dst")
    entries = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.col("multiplicity").cast("double").alias("w"))
    loops = nodes.select("node", F.col("node").alias("other"), F.lit(1.0).alias("w"))
    summed = entries.unionByName(loops).groupBy("node", "other").agg(F.sum("w").alias("w"))
    # a node's total is summed in parts, so that a hub is no long task
    total = entries.unionByName(loops).groupBy(F.col("node").alias("_node")).agg(F.sum("w").alias("_all"))
    return summed.join(total.hint("merge"), F.col("node") == F.col("_node")).select("node", "other", (F.col("w") / F.col("_all")).alias("weight"))


def propagate(weights: DataFrame, state: DataFrame, columns: Sequence[str], hops: int) -> list[DataFrame]:
    """States after 1..hops steps of weighted averaging: each (node, columns).

    A hop is one join and one aggregation; each is stored, which cuts the lineage. The joins of this
    module's features are told to merge: a table with a row per node takes little as a file, by which
    the optimizer would choose a broadcast, and many times that on the driver.
    """
    out = []
    for _ in range(hops):
        met = weights.join(state.withColumnRenamed("node", "other").hint("merge"), "other")
        state = stored(met.groupBy("node").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns]), "hop")
        out.append(state)
    return out


def base_features(nodes: DataFrame, types: Sequence[str], categories: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One-hot driver type and site category, log1p of six numbers (the 0/1 output flag too)."""
    numbers = ["is_primary_output", "cell_fanout", "in_degree_branches", "out_degree_branches", "in_neighbor_count", "out_neighbor_count"]
    cols = [(f"driver_type_{t}", F.coalesce((F.col("driver_cell_type") == t).cast("double"), F.lit(0.0))) for t in types]
    cols += [(f"site_category_{c}", F.coalesce((F.col("site_category") == c).cast("double"), F.lit(0.0))) for c in categories]
    cols += [(f"log1p_{n}", F.log1p(F.col(n).cast("double"))) for n in numbers]
    return nodes.select("node", *[c.alias(n) for n, c in cols]), [n for n, _ in cols]


def graph_features(edges: DataFrame, nodes: DataFrame, base: DataFrame, columns: Sequence[str], hops: int) -> DataFrame:
    """Base features, then inbound hops, then outbound hops: (node, features array)."""
    out = base.select("node", F.array(*columns).alias("h0"))
    part = 0
    for direction in ("inbound", "outbound"):
        # stored: each hop reads the weights, which come from all branches
        for state in propagate(stored(adjacency(edges, nodes, direction), "weights"), base, columns, hops):
            part += 1
            out = out.join(state.select("node", F.array(*columns).alias(f"h{part}")).hint("merge"), "node")
    return out.select("node", F.concat(*[F.col(f"h{k}") for k in range(part + 1)]).alias("features"))


def scaled(features: DataFrame, fit_on: DataFrame, width: int) -> DataFrame:
    """Standardised vectors: mean and population deviation from the nodes of fit_on only; a deviation of 0 counts as 1."""
    train = features.join(fit_on.select("node"), "node", "left_semi")
    stats = train.agg(F.array(*[F.avg(F.col("features")[i]) for i in range(width)]).alias("mean"), F.array(*[F.stddev_pop(F.col("features")[i]) for i in range(width)]).alias("scale")).first()
    mean = F.array(*[F.lit(float(x)) for x in stats["mean"]])
    scale = F.array(*[F.lit(float(x) or 1.0) for x in stats["scale"]])
    return features.select("node", F.zip_with(F.zip_with("features", mean, lambda a, b: a - b), scale, lambda a, b: (a / b).cast("float")).alias("features"))


def weak_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node reachable when directions are ignored.

    Whole numbers go the way of components(). Labels of other nodes fall by neighbour minimum and by
    pointer jumping in turn; each round is stored.
    """
    if isinstance(edges.schema["src"].dataType, (IntegerType, LongType)):
        links = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
        found = components(links).withColumnRenamed("component", "_least")
        every = nodes.select("node").distinct()
        return every.join(found, every["node"] == found["u"], "left").select("node", F.coalesce("_least", "node").cast(nodes.schema["node"].dataType).alias("component"))
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct(), "edges")
    label = stored(nodes.select("node", F.col("node").alias("component")).distinct(), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        low = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("was"))
        jump = low.join(label.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left")
        new = stored(jump.select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "was"), "labels")
        changed = new.filter("component <> was").limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label


#: Arcs that one task may finish: a checked bound, some tens of MB.
LOCAL_ARCS = 500_000


def _strong(frames):
    """Over all arcs left: (node, component), by depth-first search with an explicit stack."""
    import pandas as pd

    held = [f for f in frames if len(f)]
    if not held:
        return
    arcs = pd.concat(held)
    nodes, flat = np.unique(np.concatenate([arcs["src"], arcs["dst"]]), return_inverse=True)
    src, dst = flat[: len(arcs)], flat[len(arcs) :]
    order = np.argsort(src, kind="stable")
    to, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(len(nodes) + 1)).tolist()
    number, low, label = [-1] * len(nodes), [0] * len(nodes), [-1] * len(nodes)
    open_: list[int] = []
    seen = 0
    for root in range(len(nodes)):
        if number[root] >= 0:
            continue
        path = [(root, first[root])]
        while path:
            v, at = path.pop()
            if number[v] < 0:
                number[v] = low[v] = seen
                seen += 1
                open_.append(v)
            elif at > first[v] and label[w := to[at - 1]] < 0:
                low[v] = min(low[v], low[w])
            while at < first[v + 1] and number[to[at]] >= 0:
                if label[to[at]] < 0:
                    low[v] = min(low[v], low[to[at]])
                at += 1
            if at < first[v + 1]:
                path += [(v, at + 1), (to[at], first[to[at]])]
            elif low[v] == number[v]:
                members = [open_.pop()]
                while members[-1] != v:
                    members.append(open_.pop())
                for m in members:
                    label[m] = max(members)
    yield pd.DataFrame({"node": nodes, "component": nodes[label]})


def strong_components(edges: DataFrame, nodes: DataFrame, local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(node, component): nodes that reach each other, named by their largest node.

    Nodes without an edge in or out are alone and leave. Once local_arcs or fewer are left, one task ends
    the work. Until then, forward colouring: the largest ancestor spreads along edges until nothing
    changes; from each root, its colour's nodes that reach it backwards are its component; they leave, and
    the rest goes on. Its rounds grow with the longest path between the components left.
    """
    todo = stored(nodes.select("node").distinct(), "todo")
    arcs = stored(edges.filter("src <> dst").select("src", "dst").distinct(), "arcs")
    done = []
    while todo.limit(1).count():
        inner = arcs.join(todo.select(F.col("node").alias("src")), "src", "left_semi").join(todo.select(F.col("node").alias("dst")), "dst", "left_semi")
        # trim: without an arc in or an arc out a node is a component of its own
        keep = inner.select(F.col("src").alias("node")).distinct().join(inner.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        alone = todo.join(keep, "node", "left_anti")
        if (n := alone.count()) > 0:
            done.append(stored(alone.select("node", F.col("node").alias("component")), "scc"))
            if n == todo.count():
                break
            todo = stored(todo.join(alone, "node", "left_anti"), "todo")
        arcs = stored(inner, "arcs")
        if arcs.limit(local_arcs + 1).count() <= local_arcs:
            rest = stored(arcs.coalesce(1).mapInPandas(_strong, "node long, component long"), "scc")
            done.append(todo.join(rest, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
            break
        if n > 0:
            continue
        colour = stored(todo.select("node", F.col("node").alias("c"), F.lit(True).alias("moved")), "colour")
        while colour.filter("moved").limit(1).count():
            came = arcs.join(colour.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("n"))
            colour = stored(colour.join(came, "node", "left").select("node", F.greatest("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") > F.col("c")).alias("moved")), "colour")
        colour = colour.select("node", "c")
        within = stored(arcs.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c")), "within")
        found = stored(colour.filter("node = c"), "found")
        size = found.count()
        while True:
            found = stored(found.union(within.join(found.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "c")).distinct(), "found")
            if (now := found.count()) == size:
                break
            size = now
        done.append(found.select("node", F.col("c").alias("component")))
        todo = stored(todo.join(found, "node", "left_anti"), "todo")
    out = done[0] if done else nodes.select("node", F.col("node").alias("component")).limit(0)
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
