"""Row rules: canonical projection, labels, invariants, populations, guards, verdicts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.scalar import hamming

#: Cycles after which a run counts as timed out, and the cycles of a run without a fault.
TIMEOUT_CYCLES, BASELINE_CYCLES = 2000, 343
# The columns that exist only after simulation, which features may not hold.
AFTER_SIMULATION = frozenset(
    {
        "target",
        "target_detected",
        "detected",
        "activity",
        "cycles",
        "baseline_cycles",
        "latency_delta",
        "timed_out",
        "unknown",
        "expected_digest",
        "actual_digest",
        "digest_hamming_distance",
        "activated_vectors",
        "detected_vectors",
        "timeout_vectors",
        "final_classification",
    }
)
#: Columns of a campaign's set-up that are no features either.
NOT_FEATURES = frozenset({"run_type", "fault_enable", "site_selection"})


def latency_delta(cycles: Column, baseline: Column) -> Column:
    return cycles - baseline


def detected(timed_out: Column, distance: Column, delta: Column) -> Column:
    """The label: any of timeout, digest change, latency change."""
    return ((timed_out == 1) | (distance != 0) | (delta != 0)).cast("int")


def canonical(raw: DataFrame) -> DataFrame:
    """A campaign row in canonical form: renamed split, lower-case digests, delta and distance added."""
    split = F.col("vector_partition") if "vector_partition" in raw.columns else F.lit("TRAIN")
    low = {c: F.lower(F.col(c)) for c in ("expected_digest", "actual_digest")}
    out = raw.withColumns({"vector_split": split, **low}).drop("vector_partition")
    return out.withColumn("latency_delta", latency_delta(F.col("cycles"), F.col("baseline_cycles"))).withColumn("digest_hamming_distance", hamming(F.col("expected_digest"), F.col("actual_digest")))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: how many rows break it (a null verdict breaks it). All rules in one pass."""
    counts = df.agg(*[F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).alias(f"r{i}") for i, ok in enumerate(rules.values())])
    pairs = ", ".join(f"'{name}', r{i}" for i, name in enumerate(rules))
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, broken)").select("rule", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))


def campaign_rules() -> dict[str, Column]:
    """Domain, label and baseline rules of a canonical row."""
    c = F.col
    base = c("run_type") == "BASELINE"
    return {
        "cycles_in_range": c("cycles").between(0, TIMEOUT_CYCLES),
        "timeout_means_last_cycle": (c("timed_out") == 0) | (c("cycles") == TIMEOUT_CYCLES),
        "baseline_cycles_fixed": c("baseline_cycles") == BASELINE_CYCLES,
        "nothing_unknown": c("unknown") == 0,
        "detected_means_activity": (c("detected") == 0) | (c("activity") == 1),
        "label_follows": c("detected") == detected(c("timed_out"), c("digest_hamming_distance"), c("latency_delta")),
        "baseline_is_clean": ~base | ((c("site_id") == "BASELINE") & (c("selector") == -1) & (c("stuck_value") == -1) & (c("detected") == 0) & (c("activity") == 0) & (c("timed_out") == 0) & (c("cycles") == BASELINE_CYCLES) & (c("digest_hamming_distance") == 0)),
    }


def enabled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("run_type") == "ENABLED")


def of_split(df: DataFrame, split: str, column: str = "vector_split") -> DataFrame:
    return df.filter(F.col(column) == split)


def without_results(columns: Iterable[str], forbidden: Iterable[str] = AFTER_SIMULATION | NOT_FEATURES) -> list[str]:
    """The columns, if none is known only after simulation; an error otherwise."""
    columns = list(columns)
    if bad := sorted(set(columns) & set(forbidden)):
        raise ValueError(f"columns known only after simulation: {bad}")
    return columns


def pruned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"columns missing: {missing}")
    return df.select(*columns)


def diagnosis_status(deviations: Column, members: Column, sites: Column) -> Column:
    return F.when(deviations == 0, "NO_OBSERVED_ANOMALY").when(members == 0, "NO_CATALOG_MATCH").when(sites == 1, "UNIQUE_SITE_IN_CATALOG").otherwise("AMBIGUOUS_SITES_IN_CATALOG")


def verdicts(actual: DataFrame, criteria: DataFrame) -> DataFrame:
    """Criteria as rows: (criterion, family, actual, operator, required, passed).

    actual: (criterion, actual); criteria: (criterion, family, operator, required). A missing actual fails.
    """
    a, r = F.col("actual"), F.col("required")
    passed = F.when(F.col("operator") == ">", a > r).when(F.col("operator") == ">=", a >= r).when(F.col("operator") == "<", a < r).when(F.col("operator") == "<=", a <= r).otherwise(a == r)
    return criteria.join(actual, "criterion", "left").select("criterion", "family", "actual", "operator", "required", F.coalesce(passed, F.lit(False)).alias("passed"))
