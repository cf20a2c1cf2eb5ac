"""Queries of checked joins, aggregates, windows, orders and sets."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultlens.functions.scalar import instance_class
from faultlens.operators import models, relational
from faultlens.plans.registry import query
from faultlens.sources.tables import table

#: Shares in percent: whole numbers, since 90,000 * 0.70 is less than 63,000 in floating point.
SIZES = {"DEV_TRAIN": 70, "DEV_CALIBRATION": 15}


def slices(n: int) -> dict[str, int]:
    """Exact sizes of the three partitions of n groups."""
    out = {k: n * share // 100 for k, share in SIZES.items()}
    return out | {"DEV_SITE_TEST": n - sum(out.values())}


SPLIT = f"""
(select c_custkey, case when r <= floor(n * 0.70) then 'DEV_TRAIN' when r <= floor(n * 0.70) + floor(n * 0.15) then 'DEV_CALIBRATION' else 'DEV_SITE_TEST' end as partition, r, split_hash
 from (select c_custkey, split_hash, row_number() over (order by split_hash, c_custkey) as r, count(*) over () as n from (select c_custkey, sha256('{relational.SPLIT_SEED}|' || c_custkey::varchar) as split_hash from customer)))
"""


def customer_split(spark, d):
    c = table(spark, d, "customer")
    return relational.ranked_split(c, "c_custkey", slices(c.count()))


@query(f"select c_custkey, partition, row_number() over (partition by partition order by r) as partition_rank, split_hash from {SPLIT}")
def group_split(spark, d):
    return customer_split(spark, d)


@query(f"select partition, count(distinct o_custkey) as n_groups, count(*) as n_rows, count(*) filter (o_orderstatus = 'F') as n_positive, round((count(*) filter (o_orderstatus = 'F'))::double / count(*), 6) as prevalence from orders join {SPLIT} s on s.c_custkey = o_custkey group by partition")
def partition_statistics(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return relational.partition_statistics(orders, customer_split(spark, d), "c_custkey", F.col("o_orderstatus") == "F")


@query(f"select a.partition as part_a, count(*) as n from {SPLIT} a join {SPLIT} b on a.c_custkey = b.c_custkey and a.partition <> b.partition group by 1")
def partition_overlap(spark, d):
    s = stored_split = customer_split(spark, d).select("c_custkey", "partition")
    other = stored_split.withColumnRenamed("partition", "other")
    return s.join(other, "c_custkey").filter("partition <> other").groupBy(F.col("partition").alias("part_a")).agg(F.count(F.lit(1)).alias("n"))


@query("""
select l_partkey, l_linenumber % 2 as stuck_value, count(*) as vectors, count(*) filter (l_tax > 0.04) as activated, count(*) filter (l_returnflag = 'R') as detected, count(*) filter (l_quantity >= 45) as timeouts,
  case when count(*) filter (l_returnflag = 'R') > 0 then 'DETECTED' when count(*) filter (l_tax > 0.04) > 0 then 'ACTIVATED_UNOBSERVED' else 'UNACTIVATED' end as final_class
from lineitem group by 1, 2
""")
def instance_summary(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_partkey", (F.col("l_linenumber") % 2).alias("stuck_value")).agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("l_tax") > 0.04).alias("activated"), F.count_if(F.col("l_returnflag") == "R").alias("detected"), F.count_if(F.col("l_quantity") >= 45).alias("timeouts"))
    return out.withColumn("final_class", instance_class(F.col("detected"), F.col("activated")))


@query("select l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) as level, count(*) as n_rows, count(*) filter (l_discount > 0.05) as n_detected from lineitem group by rollup (l_returnflag, l_linestatus)")
def batch_rollup(spark, d):
    return relational.closure(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n_rows": F.count(F.lit(1)), "n_detected": F.count_if(F.col("l_discount") > 0.05)})


@query("""
with t as (select l_returnflag as f, l_linestatus as s, count(*) as n from lineitem group by 1, 2), u as (select f, sum(n) as n from t group by 1)
select (select sum(n) from u)::bigint as from_batches, (select count(*) from lineitem) as from_rows, (select sum(n) from u) = (select count(*) from lineitem) as closed
""")
def rollup_closure(spark, d):
    r = relational.closure(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1))})
    out = r.agg(F.sum(F.when(F.col("level") == 1, F.col("n"))).alias("from_batches"), F.sum(F.when(F.col("level") == 3, F.col("n"))).alias("from_rows"))
    return out.withColumn("closed", F.col("from_batches") == F.col("from_rows"))


@query("select event_type, event_id % 64 as slot, count(*) as n, count(*) filter (value > 50) as n_high from events group by 1, 2")
def slot_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("event_id") % 64).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))


@query("select count(*) filter (value > 50) as digest_mismatch, count(*) filter (user_id % 3 = 0) as latency_mismatch, count(*) filter (event_type = 'click') as timed_out, count(*) filter (value > 50 or user_id % 3 = 0 or event_type = 'click') as any_reason from events")
def reason_overlap(spark, d):
    a, b, c = F.col("value") > 50, F.col("user_id") % 3 == 0, F.col("event_type") == "click"
    return table(spark, d, "events").agg(F.count_if(a).alias("digest_mismatch"), F.count_if(b).alias("latency_mismatch"), F.count_if(c).alias("timed_out"), F.count_if(a | b | c).alias("any_reason"))


@query("select n_nationkey, p_size from nation, (select distinct p_size from part) except select c_nationkey, (c_custkey % 50)::int from customer")
def coverage_gaps(spark, d):
    cases = relational.expected_cases(table(spark, d, "nation").select("n_nationkey"), table(spark, d, "part").select("p_size").distinct())
    facts = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 50).cast("int").alias("p_size"))
    return relational.coverage_gaps(facts, cases, ["n_nationkey", "p_size"])


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def repeated_keys(spark, d):
    return relational.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select user_id, count(*) as n, count(distinct event_type) as cases from events group by 1 having count(distinct event_type) <> 5 or count(*) <> count(distinct event_type)")
def incomplete_groups(spark, d):
    return relational.incomplete_groups(table(spark, d, "events"), ["user_id"], ["event_type"], 5)


@query("select count(*) as n_facts, count(*) filter (s_suppkey is null) as n_unmatched, count(*) filter (s_suppkey is not null and s_nationkey <> (l_suppkey % 25)) as n_different from lineitem left join supplier on s_suppkey = l_suppkey")
def reference_mismatch(spark, d):
    facts = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_suppkey") % 25).cast("int").alias("s_nationkey"))
    return relational.reference_mismatch(facts, table(spark, d, "supplier"), ["s_suppkey"], ["s_nationkey"])


@query("select count(*) filter (a is not null and b is not null) as n_both, count(*) filter (b is null) as n_left_only, count(*) filter (a is null) as n_right_only from (select distinct c_custkey as a from customer) full join (select distinct o_custkey as b from orders) on a = b")
def full_outer_match(spark, d):
    return relational.both_ways(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def unmatched_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return relational.unmatched(c, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select l_partkey as k from lineitem where l_quantity > 48 intersect select p_partkey from part where p_size > 40")
def key_intersection(spark, d):
    a = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("k"))
    return relational.overlap(a, table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("k")), "k")


@query("select (select count(*) from (select n_regionkey from nation except all select r_regionkey from region)) as left_only, (select count(*) from (select r_regionkey from region except all select n_regionkey from nation)) as right_only")
def set_equality(spark, d):
    return relational.set_difference_sizes(table(spark, d, "nation").select("n_regionkey"), table(spark, d, "region").select("r_regionkey"))


@query("select o_orderpriority, count(*) as n from (select * from orders where o_orderstatus = 'F' union all select * from orders where o_orderstatus = 'P') group by 1")
def batch_union(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").unionByName(o.filter("o_orderstatus = 'P'")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct l_partkey, l_suppkey from lineitem")
def distinct_pairs(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("select o_orderkey, row_number() over (order by o_orderstatus, o_orderkey) - 1 as record_id from orders")
def record_ids(spark, d):
    return relational.record_ids(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"]).select("o_orderkey", F.col("record_id").cast("long").alias("record_id"))


@query("select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as partition_row from orders")
def partition_row_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1).cast("long").alias("partition_row"))


@query("select coalesce(min(k) = 0 and max(k) - min(k) + 1 = count(*) and count(distinct k) = count(*), true) as contiguous, count(*) as n from (select n_nationkey as k from nation)")
def contiguity(spark, d):
    return relational.is_contiguous(table(spark, d, "nation"), "n_nationkey")


@query("select sha256(string_agg(n_nationkey::varchar || '|' || n_name || '|' || n_regionkey::varchar, chr(10) order by n_nationkey)) as commitment from nation")
def ordered_commitment(spark, d):
    return relational.commitment(table(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"])


@query("select count(*) as n, sum(('0x' || substr(sha256(o_orderkey::varchar || '|' || o_custkey::varchar || '|' || o_orderstatus), 1, 12))::bigint)::decimal(38, 0)::varchar as digest_sum from orders")
def row_set_commitment(spark, d):
    return relational.row_set_hash(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"]).select("n", F.col("digest_sum").cast("string").alias("digest_sum"))


@query("select p_partkey, round((p_retailprice - m) / s, 6) as z from part, (select avg(p_retailprice) as m, stddev_pop(p_retailprice) as s from part where p_size <= 25)")
def train_scaled(spark, d):
    return models.z_scored(table(spark, d, "part"), "p_retailprice", F.col("p_size") <= 25, "z").select("p_partkey", F.round("z", 6).alias("z"))


@query("select p_brand, row_number() over (order by p_brand) - 1 as code from (select distinct p_brand from part)")
def value_vocabulary(spark, d):
    return relational.vocabulary(table(spark, d, "part"), "p_brand").withColumn("code", F.col("code").cast("long"))


@query("select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, round(l_linenumber + 2 * p_size + 3 * p_retailprice + 4 * s_acctbal + 5 * s_nationkey, 4) as digest, 5 as width from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey")
def star_vectors(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("pf"))
    supp = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double")).alias("sf"))
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    v = models.star_vectors(facts, [(part, "l_partkey", "pf"), (supp, "l_suppkey", "sf")], ["l_linenumber"])
    dot = sum((F.col("vector")[k] * (k + 1) for k in range(1, 5)), F.col("vector")[0])
    return v.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", F.round(dot, 4).alias("digest"), F.size("vector").alias("width"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 1")
def best_candidate(spark, d):
    return relational.best_row(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


@query("select c_mktsegment, c_custkey from (select *, row_number() over (partition by c_mktsegment order by c_custkey) as r from customer) where r <= 10")
def first_candidates(spark, d):
    return relational.least_member(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", k=10)


@query("select c_nationkey, min(c_custkey) as c_custkey from customer group by 1")
def least_members(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))


@query("with n as (select count(*) as n from orders), r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders) select o_orderkey, pos from r, n where pos in (select floor(i * (n.n - 1) / 63.0::double)::bigint from range(64) t(i))")
def even_probes(spark, d):
    o = relational.record_ids(table(spark, d, "orders").withColumn("_b", F.floor(F.col("o_orderkey") / 4096)), "_b", ["o_orderkey"], "pos")
    return relational.even_probes(o.select("o_orderkey", F.col("pos").cast("long").alias("pos")), "pos", 64, o.count())


@query("select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49)")
def semi_join(spark, d):
    return table(spark, d, "supplier").select("s_suppkey").join(table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")
