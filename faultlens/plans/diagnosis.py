"""Queries of profiles and diagnosis: an order is an instance, its customer the site, its lineitems the responses."""

from pyspark.sql import functions as F

from faultlens.operators import diagnosis
from faultlens.operators.rows import diagnosis_status
from faultlens.plans.registry import query
from faultlens.sources.tables import table

TOKEN = "l_returnflag || l_linestatus || (l_linenumber::varchar)"
PROFILES = f"(select l_orderkey, string_agg({TOKEN}, ';' order by {TOKEN}) as profile from lineitem group by l_orderkey)"
SITED = f"(select p.l_orderkey, p.profile, (p.l_orderkey // 2) as site from {PROFILES} p)"
GROUPS = f"(select profile, count(*) as n_instances, count(distinct site) as n_sites, sha256(profile) as profile_sha256 from {SITED} group by profile)"
NORMAL = "NO1"


def by_order(spark, d):
    token = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    rows = table(spark, d, "lineitem").withColumn("token", token)
    return diagnosis.profiles(rows, "l_orderkey", "token", F.col("token"))


def site():
    return F.floor(F.col("l_orderkey") / 2)


@query(f"select * from {PROFILES}")
def response_profiles(spark, d):
    return by_order(spark, d)


@query(f"select * from {GROUPS}")
def profile_groups(spark, d):
    return diagnosis.groups(by_order(spark, d), "l_orderkey", site())


@query(f"""
select count(*) as distinct_profiles, coalesce(sum(n_instances) filter (profile = '{NORMAL}'), 0)::bigint as indistinguishable_instances, coalesce(sum(n_instances) filter (profile <> '{NORMAL}' and n_sites = 1), 0)::bigint as unique_site_instances,
 coalesce(sum(n_instances) filter (profile <> '{NORMAL}' and n_sites > 1), 0)::bigint as ambiguous_instances, count(*) filter (profile <> '{NORMAL}' and n_instances = 1) as unique_instance_profiles, coalesce(max(n_sites) filter (profile <> '{NORMAL}'), 0) as largest_site_set from {GROUPS}
""")
def distinguishability(spark, d):
    return diagnosis.distinguishability(profile_groups(spark, d), NORMAL)


@query(f"select n_sites, count(*) as n_profiles from {GROUPS} where profile <> '{NORMAL}' group by n_sites")
def candidate_histogram(spark, d):
    return diagnosis.site_histogram(profile_groups(spark, d), NORMAL)


@query(f"select row_number() over (order by sha256(profile), profile) - 1 as profile_id, sha256(profile) as profile_sha256, profile as response from (select distinct profile from {PROFILES})")
def catalogue_profiles(spark, d):
    ids, _ = diagnosis.catalogue(by_order(spark, d), "l_orderkey")
    return ids.withColumn("profile_id", F.col("profile_id").cast("long"))


#: Every order is a case; one in a hundred shows a response that no profile has. Candidates are kept per profile, not per case.
KNOWN = f"(select profile, count(*) as n_members, list_sort(list_distinct(list(site))) as candidate_sites from {SITED} group by profile)"
SEEN = f"(select l_orderkey as case_id, case when l_orderkey % 100 = 0 then profile || 'X' else profile end as profile from {PROFILES})"
FOUND = f"(select case_id, coalesce(n_members, 0) as n_members, candidate_sites from {SEEN} q left join {KNOWN} k on k.profile = q.profile)"


def observed(spark, d):
    return by_order(spark, d).select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_orderkey") % 100 == 0, F.concat("profile", F.lit("X"))).otherwise(F.col("profile")).alias("profile"))


def per_profile(spark, d, asked):
    """Each distinct profile asked for, looked up once: cases of one profile times its members would grow as the square."""
    ids, faults = diagnosis.catalogue(by_order(spark, d), "l_orderkey")
    once = asked.select("profile", F.col("profile").alias("asked")).distinct()
    return diagnosis.lookup(once, ids, faults, "asked", "l_orderkey", site())


@query(f"select case_id, n_members, coalesce(len(candidate_sites), 0)::int as n_sites, coalesce(list_sum(candidate_sites), 0)::bigint as site_sum from {FOUND}")
def catalogue_lookup(spark, d):
    seen = observed(spark, d)
    hits = per_profile(spark, d, seen).select("asked", "n_members", F.size("candidate_sites").alias("n_sites"), F.aggregate("candidate_sites", F.lit(0).cast("long"), lambda a, x: a + x).alias("site_sum"))
    return seen.join(hits, seen["profile"] == hits["asked"]).select("case_id", "n_members", "n_sites", "site_sum")


def observations(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("slot"), (F.col("l_tax") > 0.07).cast("int").alias("timed_out"), F.col("l_returnflag").alias("digest"), F.col("l_quantity").cast("int").alias("cycles"))


REASONS = "(select *, case when timed_out = 1 then 'TIMEOUT' when digest <> 'N' then 'DIGEST_MISMATCH' else '' end || case when cycles <> 25 then '+LATENCY_MISMATCH' else '' end as r from (select l_orderkey as case_id, case when l_tax > 0.07 then 1 else 0 end as timed_out, l_returnflag as digest, l_quantity::int as cycles from lineitem))"


def deviating(spark, d):
    slots = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("slot")).distinct()
    return diagnosis.deviations(observations(spark, d), slots.select("slot", F.lit("N").alias("digest"), F.lit(25).alias("cycles")), "slot")


@query(f"select reasons, count(*) as n from (select trim(r, '+') as reasons from {REASONS} where r <> '') group by 1")
def deviation_reasons(spark, d):
    return deviating(spark, d).groupBy(F.array_join("reasons", "+").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
select f.case_id, coalesce(n, 0) as n_deviating, n_members, coalesce(len(candidate_sites), 0)::int as n_sites,
 case when coalesce(n, 0) = 0 then 'NO_OBSERVED_ANOMALY' when n_members = 0 then 'NO_CATALOG_MATCH' when len(candidate_sites) = 1 then 'UNIQUE_SITE_IN_CATALOG' else 'AMBIGUOUS_SITES_IN_CATALOG' end as result
from {FOUND} f left join (select case_id, count(*) as n from {REASONS} where r <> '' group by 1) v on v.case_id = f.case_id
""")
def diagnose_observations(spark, d):
    n = deviating(spark, d).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_deviating"))
    out = catalogue_lookup(spark, d).join(n, "case_id", "left").withColumn("n_deviating", F.coalesce("n_deviating", F.lit(0)))
    return out.select("case_id", "n_deviating", "n_members", "n_sites", diagnosis_status(F.col("n_deviating"), F.col("n_members"), F.col("n_sites")).alias("result"))


@query(f"select count(*) as inconsistent from {SITED} s join {KNOWN} k on k.profile = s.profile where not list_contains(candidate_sites, site)")
def catalogue_self_check(spark, d):
    """Every stored profile, diagnosed as it stands: instances whose own site is not among the candidates."""
    stored = by_order(spark, d)
    truth = stored.select("l_orderkey", "profile", site().alias("site"))
    named = per_profile(spark, d, stored).select(F.col("asked").alias("profile"), F.explode("candidate_sites").alias("site"))
    return truth.join(named, ["profile", "site"], "left_anti").agg(F.count(F.lit(1)).alias("inconsistent"))


STRATA = {"1-URGENT": 4, "2-HIGH": 4, "5-LOW": 2}
STRATIFIED = "(select o_orderkey, o_orderpriority, o_orderstatus, o_custkey from (select *, row_number() over (partition by o_orderpriority order by sha256('pilot|' || o_orderkey::varchar), o_orderkey) as r from orders) where (o_orderpriority in ('1-URGENT', '2-HIGH') and r <= 4) or (o_orderpriority = '5-LOW' and r <= 2))"


@query(f"select o_orderkey, o_orderpriority from {STRATIFIED}")
def stratified_sample(spark, d):
    return diagnosis.stratified(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", STRATA, "pilot").select("o_orderkey", "o_orderpriority")


@query("""
with t as (select o_orderkey as case_id, o_orderstatus <> 'O' as fault_present, o_custkey % 10 as site, ['UNIQUE', 'AMBIGUOUS', 'INVISIBLE'][(o_orderkey % 3)::int + 1] as cat, o_orderkey % 4 <> 0 as anomaly, case when o_orderkey % 5 = 0 then [o_custkey % 10] else [o_custkey % 10, 11] end as cand from orders)
select 'false_alarms' as measure, count(*) filter (not fault_present and anomaly) as numerator, count(*) filter (not fault_present) as denominator from t
union all select 'observable_detected', count(*) filter (fault_present and cat <> 'INVISIBLE' and anomaly), count(*) filter (fault_present and cat <> 'INVISIBLE') from t
union all select 'all_detected', count(*) filter (fault_present and anomaly), count(*) filter (fault_present) from t
union all select 'exact_site_unique', count(*) filter (fault_present and anomaly and len(cand) = 1 and cat = 'UNIQUE'), count(*) filter (fault_present and cat = 'UNIQUE') from t
union all select 'exact_site_all', count(*) filter (fault_present and anomaly and len(cand) = 1), count(*) filter (fault_present) from t
union all select 'candidate_coverage', count(*) filter (fault_present and cat <> 'INVISIBLE'), count(*) filter (fault_present and cat <> 'INVISIBLE') from t
""")
def blinded_score(spark, d):
    return blinded(table(spark, d, "orders"))


def blinded(o):
    k, s = F.col("o_orderkey"), F.col("o_custkey") % 10
    truth = o.select(k.alias("case_id"), (F.col("o_orderstatus") != "O").alias("fault_present"), s.alias("site"), F.element_at(F.array(F.lit("UNIQUE"), F.lit("AMBIGUOUS"), F.lit("INVISIBLE")), (k % 3 + 1).cast("int")).alias("selection_category"))
    said = o.select(k.alias("case_id"), F.when(k % 4 != 0, "AMBIGUOUS_SITES_IN_CATALOG").otherwise("NO_OBSERVED_ANOMALY").alias("result"), F.when(k % 5 == 0, F.array(s)).otherwise(F.array(s, F.lit(11).cast("long"))).alias("candidate_sites"))
    return diagnosis.score_blinded(truth, said)
