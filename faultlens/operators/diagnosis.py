"""Response profiles, their catalogue, exact lookup, and blinded scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultlens.operators.rows import diagnosis_status
from faultlens.sources.tables import stored


def profiles(observations: DataFrame, instance: str, slot: str, token: Column) -> DataFrame:
    """(instance, profile): an instance's tokens in slot order, as one text."""
    rows = observations.groupBy(instance).agg(F.array_sort(F.collect_list(F.struct(F.col(slot).alias("s"), token.alias("t")))).alias("r"))
    return rows.select(instance, F.array_join(F.transform("r", lambda x: x["t"]), ";").alias("profile"))


def groups(by_instance: DataFrame, instance: str, site: Column) -> DataFrame:
    """Instances with identical profiles: (profile, profile_sha256, n_instances, n_sites).

    Partial sums by (profile, site) come first, so that a profile many instances share is no long task.
    """
    per = by_instance.groupBy("profile", site.alias("site")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("profile").agg(F.sum("n").alias("n_instances"), F.count(F.lit(1)).alias("n_sites")).withColumn("profile_sha256", F.sha2("profile", 256))


def distinguishability(grouped: DataFrame, normal: str | None) -> DataFrame:
    """One row: how far profiles tell faults apart. Histograms count profiles, the other figures instances."""
    g = grouped.withColumn("normal", F.col("profile").eqNullSafe(F.lit(normal)))
    seen = ~F.col("normal")
    total = lambda cond, v: F.coalesce(F.sum(F.when(cond, F.col(v))), F.lit(0)).cast("long")
    return g.agg(
        F.count(F.lit(1)).alias("distinct_profiles"),
        total(F.col("normal"), "n_instances").alias("indistinguishable_instances"),
        total(seen & (F.col("n_sites") == 1), "n_instances").alias("unique_site_instances"),
        total(seen & (F.col("n_sites") > 1), "n_instances").alias("ambiguous_instances"),
        F.count_if(seen & (F.col("n_instances") == 1)).alias("unique_instance_profiles"),
        F.coalesce(F.max(F.when(seen, F.col("n_sites"))), F.lit(0)).alias("largest_site_set"),
    )


def site_histogram(grouped: DataFrame, normal: str | None) -> DataFrame:
    return grouped.filter(~F.col("profile").eqNullSafe(F.lit(normal))).groupBy("n_sites").agg(F.count(F.lit(1)).alias("n_profiles"))


def catalogue(by_instance: DataFrame, instance: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, faults): profile_id, profile_sha256, response; and instance, profile_id.

    Ids follow the digest's order inside ranges of it, numbered as batches are.
    """
    distinct = by_instance.select("profile").distinct().withColumn("profile_sha256", F.sha2("profile", 256)).withColumn("range", F.substring("profile_sha256", 1, 2))
    sizes = distinct.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("profile_sha256", "profile"))
    ids = distinct.withColumn("place", place).join(before, "range").select((F.col("place") - 1 + F.col("off")).alias("profile_id"), "profile_sha256", F.col("profile").alias("response"))
    ids = stored(ids, "profiles")
    q = by_instance.select(instance, "profile", F.sha2("profile", 256).alias("_sha"))
    faults = q.join(ids, (F.col("_sha") == F.col("profile_sha256")) & (F.col("profile") == F.col("response"))).select(instance, "profile_id")
    return ids, faults


def lookup(observed: DataFrame, ids: DataFrame, faults: DataFrame, case: str, instance: str, site: Column) -> DataFrame:
    """Per case: the faults of the one profile with equal digest and equal bytes, and their distinct sites.

    Members and sites are summed per profile, sites first, before any case meets them.
    """
    per = faults.groupBy("profile_id", site.alias("_site")).agg(F.count(instance).alias("n"))
    known = per.groupBy("profile_id").agg(F.sum("n").alias("n_members"), F.array_sort(F.collect_list("_site")).alias("candidate_sites"))
    q = observed.select(case, "profile", F.sha2("profile", 256).alias("_sha"))
    hit = q.join(ids, (F.col("_sha") == F.col("profile_sha256")) & (q["profile"] == ids["response"]), "left").select(case, "profile_id")
    out = hit.join(known, "profile_id", "left")
    return out.select(case, F.coalesce("n_members", F.lit(0)).cast("long").alias("n_members"), F.coalesce("candidate_sites", F.array().cast(known.schema["candidate_sites"].dataType)).alias("candidate_sites"))


def deviations(observed: DataFrame, golden: DataFrame, slot: str) -> DataFrame:
    """Observations that differ from the fault-free run, with their reasons.

    observed and golden: slot, timed_out, cycles, digest. A timeout hides the digest; latency counts apart.
    """
    g = golden.select(slot, F.col("cycles").alias("_cycles"), F.col("digest").alias("_digest"))
    met = observed.join(g, slot)
    first = F.when(F.col("timed_out") == 1, F.lit("TIMEOUT")).when(~F.col("digest").eqNullSafe(F.col("_digest")), F.lit("DIGEST_MISMATCH"))
    late = F.when(F.col("cycles") != F.col("_cycles"), F.lit("LATENCY_MISMATCH"))
    return met.withColumn("reasons", F.array_compact(F.array(first, late))).filter(F.size("reasons") > 0).drop("_cycles", "_digest")


def diagnose(observed: DataFrame, found: DataFrame, deviating: DataFrame, case: str) -> DataFrame:
    """Per case: deviating tests, members, candidate sites and the verdict."""
    n = deviating.groupBy(case).agg(F.count(F.lit(1)).alias("n_deviating"))
    out = observed.select(case).distinct().join(n, case, "left").join(found, case, "left")
    d, m = F.coalesce("n_deviating", F.lit(0)), F.coalesce("n_members", F.lit(0))
    sites = F.coalesce(F.size("candidate_sites"), F.lit(0))
    return out.select(case, d.alias("n_deviating"), m.alias("n_members"), sites.alias("n_sites"), diagnosis_status(d, m, sites).alias("result"), "candidate_sites")


def self_check(found: DataFrame, truth: DataFrame, case: str, site: str) -> DataFrame:
    """Cases whose candidates lack their own site: empty for a consistent catalogue."""
    return truth.join(found, case, "left").filter(~F.coalesce(F.array_contains("candidate_sites", F.col(site)), F.lit(False)))


def stratified(population: DataFrame, category: str, key: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """Per category, the first `sizes[category]` members by sha256(seed|key): a sample without replacement.

    A category at a time, so that only the best of each part meet.
    """
    hashed = population.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256))
    out = None
    for value, size in sizes.items():
        part = hashed.filter(F.col(category) == value).orderBy("_h", key).limit(size)
        out = part if out is None else out.unionByName(part)
    return out.drop("_h")


def score_blinded(truth: DataFrame, predictions: DataFrame, case: str = "case_id") -> DataFrame:
    """Fractions (measure, numerator, denominator) of blinded predictions against the truth.

    truth: case, fault_present, site, selection_category; predictions: case, result, candidate_sites.
    """
    met = truth.join(predictions, case)
    present, observable = F.col("fault_present"), F.col("selection_category") != "INVISIBLE"
    anomaly = F.col("result") != "NO_OBSERVED_ANOMALY"
    covered = F.coalesce(F.array_contains("candidate_sites", F.col("site")), F.lit(False))
    exact = covered & (F.size("candidate_sites") == 1)
    measures = {
        "false_alarms": (~present & anomaly, ~present),
        "observable_detected": (present & observable & anomaly, present & observable),
        "all_detected": (present & anomaly, present),
        "exact_site_unique": (present & anomaly & exact & (F.col("selection_category") == "UNIQUE"), present & (F.col("selection_category") == "UNIQUE")),
        "exact_site_all": (present & anomaly & exact, present),
        "candidate_coverage": (present & observable & covered, present & observable),
    }
    sums = met.agg(*[F.count_if(c).alias(f"{n}_{k}") for n, cs in measures.items() for k, c in zip("nd", cs, strict=True)])
    pairs = ", ".join(f"'{n}', {n}_n, {n}_d" for n in measures)
    return sums.selectExpr(f"stack({len(measures)}, {pairs}) as (measure, numerator, denominator)")


def intake_errors(observations: DataFrame, suite: DataFrame, steps: int) -> DataFrame:
    """(rule, broken) of an observation table against its test suite (vector_slot, vector_id); all zero if it can be taken in."""
    from faultlens.operators.rows import violations

    o = observations.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("vector_slot")))
    met = o.join(suite.select("vector_slot", F.col("vector_id").alias("_id")), "vector_slot", "left")
    out = F.col("timed_out")
    rules: dict[str, Column] = {
        "known_slot": F.col("_id").isNotNull(),
        "slot_once": F.col("_n") == 1,
        "vector_id": F.col("vector_id") == F.col("_id"),
        "timed_out_bit": out.isin(0, 1),
        "cycles_in_range": F.col("cycles").between(0, 2000),
        "timeout_cycles": (out != 1) | (F.col("cycles") == 2000),
        "digest": F.coalesce(F.col("actual_digest").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)) | ((out == 1) & (F.coalesce("actual_digest", F.lit("")) == "")),
    }
    rows = violations(met, rules)
    count = observations.agg(F.lit("row_count").alias("rule"), F.abs(F.count(F.lit(1)) - steps).alias("broken"))
    return rows.unionByName(count)


def select_columns(df: DataFrame, exact: Sequence[str]) -> DataFrame:
    """df if its columns are exactly these, in order; an error otherwise."""
    if list(df.columns) != list(exact):
        raise ValueError(f"columns are {df.columns}, not {list(exact)}")
    return df
