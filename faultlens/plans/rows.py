"""Queries of row rules and scalar functions."""

from pyspark.sql import functions as F

from faultlens.functions import scalar
from faultlens.operators import integrity, rows
from faultlens.plans.registry import query
from faultlens.sources.tables import table

HAMMING = " + ".join(f"bit_count(xor(('0x' || substr(a, {k}, 8))::bigint, ('0x' || substr(b, {k}, 8))::bigint))::int" for k in range(1, 65, 8))


@query("select l_orderkey, l_linenumber, l_partkey, lower(l_returnflag) as flag, 'TRAIN' as vector_split, l_quantity - 25 as latency_delta from lineitem")
def canonical_projection(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.lower("l_returnflag").alias("flag"), F.lit("TRAIN").alias("vector_split"), rows.latency_delta(F.col("l_quantity"), F.lit(25)).alias("latency_delta"))


@query(f"select c_custkey, ({HAMMING})::int as distance from (select c_custkey, sha256(c_custkey::varchar) as a, sha256((c_custkey + 1)::varchar) as b from customer)")
def digest_hamming(spark, d):
    sha = lambda c: F.sha2(c.cast("string"), 256)
    return table(spark, d, "customer").select("c_custkey", scalar.hamming(sha(F.col("c_custkey")), sha(F.col("c_custkey") + 1)).alias("distance"))


@query("select case when l_tax > 0.07 or l_linenumber <> 1 or l_quantity <> 25 then 1 else 0 end as detected, count(*) as n, sum(l_quantity) as quantity from lineitem group by 1")
def label_rule(spark, d):
    label = rows.detected((F.col("l_tax") > 0.07).cast("int"), F.col("l_linenumber") - 1, F.col("l_quantity") - 25)
    return table(spark, d, "lineitem").groupBy(label.alias("detected")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""
select 'quantity_in_range' as rule, count(*) filter (not (l_quantity between 1 and 45)) as broken from lineitem
union all select 'returned_means_filled', count(*) filter (not (l_returnflag <> 'R' or l_linestatus = 'F')) from lineitem
union all select 'baseline_line', count(*) filter (not (l_linenumber <> 1 or l_discount < 0.1)) from lineitem
union all select 'tax_in_range', count(*) filter (not (l_tax between 0 and 0.08)) from lineitem
""")
def invariant_violations(spark, d):
    c = F.col
    rules = {"quantity_in_range": c("l_quantity").between(1, 45), "returned_means_filled": (c("l_returnflag") != "R") | (c("l_linestatus") == "F"), "baseline_line": (c("l_linenumber") != 1) | (c("l_discount") < 0.1), "tax_in_range": c("l_tax").between(0, 0.08)}
    return rows.violations(table(spark, d, "lineitem"), rules)


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderstatus <> 'O' group by o_orderstatus")
def population_filter(spark, d):
    return rows.of_split(table(spark, d, "orders").withColumn("live", F.when(F.col("o_orderstatus") != "O", "ENABLED").otherwise("BASELINE")), "ENABLED", "live").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select p_partkey, p_size from part")
def guarded_columns(spark, d):
    return rows.pruned(table(spark, d, "part"), rows.without_results(["p_partkey", "p_size"]))


@query("""
select p_partkey, case when port in ('C', 'CLK', 'CLOCK') then 'CLOCK' when port in ('R', 'RN', 'RESET', 'RST', 'CLR', 'ARST', 'SRST') then 'RESET' when port in ('E', 'EN', 'ENABLE', 'CE') then 'ENABLE'
 when port in ('S', 'SEL', 'SELECT') or (kind like '%MUX%' and port like 'S%') then 'SELECT' when port in ('D', 'I', 'IN', 'DATA') or port like 'A%' or port like 'B%' then 'DATA' else 'OTHER' end as role
from (select p_partkey, upper(ltrim(['\\clk', 'RST', 'en', 'S0', 'A1', 'b', 'Q', 'sel'][(p_partkey % 8)::int + 1], '\\')) as port, case when p_size > 25 then '$_MUX_' else '$_AND_' end as kind from part)
""")
def branch_roles(spark, d):
    port = F.element_at(F.array(*[F.lit(x) for x in ("\\clk", "RST", "en", "S0", "A1", "b", "Q", "sel")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", scalar.edge_role(F.when(F.col("p_size") > 25, "$_MUX_").otherwise("$_AND_"), port).alias("role"))


@query("""
select c_custkey, 'SITE-' || lpad(c_custkey::varchar, 6, '0') as site, regexp_replace(c_name || '[' || (c_custkey % 10)::varchar || ']', '\\[[0-9]+\\]$', '') as net, lpad(bin(c_custkey % 512), 9, '0') as selector,
  regexp_matches(c_name, '^(0|-?[1-9][0-9]*)$') as canonical, split_part(c_name, '#', 2) as tail, lpad(regexp_replace(lower(trim(' 0xAB' || (c_custkey % 10)::varchar || ' ')), '^0x', ''), 8, '0') as hex
from customer
""")
def text_functions(spark, d):
    key = F.col("c_custkey")
    small = (key % 10).cast("string")
    return table(spark, d, "customer").select("c_custkey", scalar.site_name(key, "SITE-").alias("site"), scalar.bare_bus(F.concat("c_name", F.lit("["), small, F.lit("]"))).alias("net"), scalar.binary_text(key % 512, 9).alias("selector"), scalar.is_canonical_int(F.col("c_name")).alias("canonical"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"), scalar.plain_hex(F.concat(F.lit(" 0xAB"), small, F.lit(" ")), 8).alias("hex"))


BITS = "list_reduce(list_transform(range(1, 9), lambda i: lpad(bin(('0x' || substr(h, i, 1))::bigint), 4, '0')), lambda a, b: a || b)"


@query(f"select c_custkey, {BITS} as bits, h as packed from (select c_custkey, substr(sha256(c_custkey::varchar), 1, 8) as h from customer)")
def key_bits(spark, d):
    digits = F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 8)
    bits = table(spark, d, "customer").select("c_custkey", scalar.bits_of(digits, 8).alias("b"))
    return bits.select("c_custkey", F.array_join(F.transform("b", lambda x: x.cast("string")), "").alias("bits"), scalar.packed(F.col("b")).alias("packed"))


PAD = lambda byte: " || ".join(f"lpad(lower(hex(xor(('0x' || substr(k, {i}, 8))::bigint, {int(byte * 4, 16)}::bigint))), 8, '0')" for i in range(1, 65, 8)) + f" || '{byte * 32}'"


@query(f"select c_custkey, sha256(unhex({PAD('5c')} || sha256(unhex({PAD('36')} || m)))) as mac from (select c_custkey, sha256('k' || c_custkey::varchar) as k, sha256('m' || c_custkey::varchar) as m from customer)")
def hmac_digests(spark, d):
    sha = lambda p: F.sha2(F.concat(F.lit(p), F.col("c_custkey").cast("string")), 256)
    return table(spark, d, "customer").select("c_custkey", scalar.hmac_sha256(sha("k"), sha("m")).alias("mac"))


@query("select user_id, bit_or(1::bigint << (event_id % 60)::int) as mask, bit_count(bit_or(1::bigint << (event_id % 60)::int))::int as slots from events group by user_id")
def coverage_mask(spark, d):
    mask = scalar.coverage_mask(F.col("event_id") % 60)
    return table(spark, d, "events").groupBy("user_id").agg(mask.alias("mask")).withColumn("slots", F.bit_count("mask").cast("int"))


@query("select p_partkey, list_transform(['Brand#1', 'Brand#2', 'Brand#3'], lambda v: case when substr(p_brand, 1, 7) = v then 1.0::float else 0.0::float end) as one_hot from part")
def one_hot_vectors(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.one_hot(F.substring("p_brand", 1, 7), ["Brand#1", "Brand#2", "Brand#3"]).alias("one_hot"))


SCAN = integrity.PATTERNS


@query(" union all ".join(f"select '{k}' as pattern, count(*) filter (regexp_matches(text, '{p}')) as n_rows from documents" for k, p in SCAN.items()))
def secret_scan(spark, d):
    return integrity.scan_text(table(spark, d, "documents"), "text")
