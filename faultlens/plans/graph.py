"""Queries of graph operators: suppliers and parts as nodes, lineitems as branches, return flags as roles."""

from pyspark.sql import functions as F

from faultlens.operators import graph
from faultlens.plans.registry import query
from faultlens.sources.tables import table

FLAGS = ("A", "N", "R")
#: Parts as negative nodes keep the two kinds apart.
EDGES = "(select l_suppkey as src, -1 - l_partkey as dst, count(*) as multiplicity, count(*) filter (l_returnflag = 'A') as a_branches, count(*) filter (l_returnflag = 'N') as n_branches, count(*) filter (l_returnflag = 'R') as r_branches, 0 as is_self_loop from lineitem group by 1, 2)"
NODES = "(select s_suppkey as node from supplier union select l_suppkey from lineitem union select -1 - p_partkey from part union select -1 - l_partkey from lineitem)"


def edges(spark, d):
    branches = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"), F.col("l_returnflag").alias("role"))
    return graph.collapse(branches, FLAGS)


def nodes(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    parts = [table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), l.select(F.col("l_suppkey").alias("node")), table(spark, d, "part").select((-1 - F.col("p_partkey")).alias("node")), l.select((-1 - F.col("l_partkey")).alias("node"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


@query(f"select * from {EDGES}")
def graph_edges(spark, d):
    return edges(spark, d)


@query(f"""
select node, coalesce(i.m, 0)::bigint as in_degree_branches, coalesce(o.m, 0)::bigint as out_degree_branches, coalesce(i.n, 0) as in_neighbor_count, coalesce(o.n, 0) as out_neighbor_count
from {NODES} left join (select dst, sum(multiplicity) as m, count(*) as n from {EDGES} group by dst) i on i.dst = node left join (select src, sum(multiplicity) as m, count(*) as n from {EDGES} group by src) o on o.src = node
""")
def graph_degrees(spark, d):
    return graph.degrees(edges(spark, d), nodes(spark, d))


KINDS = "(select c_custkey, case when c_custkey % 7 = 0 then 'CONSTANT' when c_custkey % 5 = 0 then 'TOP_INPUT' when c_custkey % 3 <> 1 then 'INTERNAL' else 'UNDRIVEN' end as kind from customer)"


@query(f"select count(*) as total, count(*) filter (kind = 'INTERNAL') as internal, count(*) filter (kind = 'TOP_INPUT') as top_input, count(*) filter (kind = 'CONSTANT') as constant, count(*) filter (kind = 'UNDRIVEN') as undriven from {KINDS}")
def branch_accounting(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey")
    pins = c.select(k.cast("string").alias("cell"), F.lit("AND").alias("cell_type"), F.lit("A").alias("port"), F.lit(0).alias("pin"), F.when(k % 7 == 0, "constant").otherwise("wire").alias("kind"), k.alias("bit"))
    drivers = c.filter((k % 3 != 1) & (k % 5 != 0)).select(k.alias("bit"), k.alias("src"))
    inputs = c.filter(k % 5 == 0).select(k.alias("bit"), F.lit("in").alias("source_name"), k.alias("source_pin"))
    return graph.branch_accounting(graph.classify_branches(pins, drivers, inputs))


WEIGHTS = f"""
ein as (select dst as node, src as other, multiplicity::double as w from {EDGES} union all select node, node, 1.0::double from {NODES}),
win as (select node, other, sum(w) / sum(sum(w)) over (partition by node) as weight from ein group by 1, 2),
eout as (select src as node, dst as other, multiplicity::double as w from {EDGES} union all select node, node, 1.0::double from {NODES}),
wout as (select node, other, sum(w) / sum(sum(w)) over (partition by node) as weight from eout group by 1, 2),
h0 as (select node, case when node >= 0 then 1.0::double else 0.0::double end as x, (abs(node) % 10)::double as y from {NODES})
"""


def hop(k: int, side: str) -> str:
    return f"{side}{k} as (select w.node, sum(weight * x) as x, sum(weight * y) as y from w{side} w join {'h0' if k == 1 else side + str(k - 1)} s on s.node = w.other group by w.node)"


HOPS = ", ".join(hop(k, side) for side in ("in", "out") for k in (1, 2, 3))


@query(f"with {WEIGHTS} select node, other, round(weight, 6) as weight from win")
def adjacency_inbound(spark, d):
    return graph.adjacency(edges(spark, d), nodes(spark, d), "inbound").withColumn("weight", F.round("weight", 6))


@query(f"with {WEIGHTS} select node, other, round(weight, 6) as weight from wout")
def adjacency_outbound(spark, d):
    return graph.adjacency(edges(spark, d), nodes(spark, d), "outbound").withColumn("weight", F.round("weight", 6))


# values that end in a half at the last place would be rounded by the order of summation
@query(f"with {WEIGHTS}, {HOPS} select h0.node, " + ", ".join(f"round({s}{k}.{c} + 1e-9::double, 6) as {s}{k}_{c}" for s in ("in", "out") for k in (1, 2, 3) for c in "xy") + " from h0 " + " ".join(f"join {s}{k} on {s}{k}.node = h0.node" for s in ("in", "out") for k in (1, 2, 3)))
def k_hop_features(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    base = n.select("node", F.when(F.col("node") >= 0, 1.0).otherwise(0.0).alias("x"), (F.abs("node") % 10).cast("double").alias("y"))
    f = graph.graph_features(e, n, base, ["x", "y"], 3)
    names = [f"{s}{k}_{c}" for s in ("in", "out") for k in (1, 2, 3) for c in "xy"]
    return f.select("node", *[F.round(F.col("features")[i + 2] + 1e-9, 6).alias(c) for i, c in enumerate(names)])


TYPES = ("FFT", "MUX", "XOR")


@query("""
select p_partkey as node, round(ln(1 + (p_size > 40)::int::double), 6) as log1p_is_primary_output, round(ln(1 + p_size::double), 6) as log1p_cell_fanout, (p_partkey % 3 = 0)::int::double as driver_type_fft, (p_partkey % 2 = 0)::int::double as site_category_comb from part
""")
def base_node_features(spark, d):
    k = F.col("p_partkey")
    n = table(spark, d, "part").select(k.alias("node"), F.element_at(F.array(*[F.lit(t) for t in TYPES]), (k % 3 + 1).cast("int")).alias("driver_cell_type"), F.when(k % 2 == 0, "COMB").otherwise("SEQ").alias("site_category"), (F.col("p_size") > 40).cast("int").alias("is_primary_output"), F.col("p_size").alias("cell_fanout"), *[F.lit(0).alias(c) for c in ("in_degree_branches", "out_degree_branches", "in_neighbor_count", "out_neighbor_count")])
    f, _ = graph.base_features(n, TYPES, ("COMB", "SEQ"))
    return f.select("node", F.round("log1p_is_primary_output", 6).alias("log1p_is_primary_output"), F.round("log1p_cell_fanout", 6).alias("log1p_cell_fanout"), F.col("driver_type_FFT").alias("driver_type_fft"), F.col("site_category_COMB").alias("site_category_comb"))


#: Customers as a sparse graph: an arc to a key a digest names.
ARCS = "(select c_custkey as src, 1 + ('0x' || substr(sha256('arc' || c_custkey::varchar), 1, 8))::bigint % (select max(c_custkey) from customer) as dst from customer)"


def arcs(spark, d):
    c = table(spark, d, "customer")
    top = c.agg(F.max("c_custkey")).first()[0]
    k = F.col("c_custkey")
    return c.select(k.alias("src"), (F.conv(F.substring(F.sha2(F.concat(F.lit("arc"), k.cast("string")), 256), 1, 8), 16, 10).cast("long") % top + 1).alias("dst"))


def arc_nodes(spark, d):
    a = arcs(spark, d)
    return a.select(F.col("src").alias("node")).union(a.select(F.col("dst").alias("node"))).distinct()


@query(f"""
with recursive a as {ARCS}, b as (select src as p, dst as q from a union select dst, src from a),
r as (select p as node, p as hop from b union select r.node, b.q from r join b on b.p = r.hop)
select node, min(hop) as component from r group by node
""")
def weak_components(spark, d):
    return graph.weak_components(arcs(spark, d), arc_nodes(spark, d))


@query(f"""
with recursive a as {ARCS}, n as (select src as node from a union select dst from a),
r as (select node, node as hop from n union select r.node, a.dst from r join a on a.src = r.hop)
select x.node, max(y.node) as component from r x join r y on y.node = x.hop and y.hop = x.node group by x.node
""")
def strong_components(spark, d):
    return graph.strong_components(arcs(spark, d), arc_nodes(spark, d))


@query(f"""
with recursive a as {ARCS}, b as (select src as p, dst as q from a union select dst, src from a),
r as (select p as node, p as hop from b union select r.node, b.q from r join b on b.p = r.hop)
select component, count(*) as size from (select node, min(hop) as component from r group by node) group by component
""")
def component_sizes(spark, d):
    return graph.component_sizes(weak_components(spark, d))
