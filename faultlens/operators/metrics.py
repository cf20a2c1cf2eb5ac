"""Classifier metrics from counts and scores: confusion, sweeps, areas, calibration, breakdowns, bootstrap.

Scores are aggregated by distinct value before anything is ordered, so that ordered windows see ties
once; thresholds, areas and curves are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultlens.functions.scalar import null_ratio, safe_ratio
from faultlens.operators.ranks import positions, running_sums

COUNTS = ("tn", "fp", "fn", "tp")


def confusion_columns(target: Column, prediction: Column) -> list[Column]:
    """Four aggregate columns."""
    cell = lambda y, p: F.sum(F.when((target == y) & (prediction == p), 1).otherwise(0)).cast("long")
    return [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]


def hard(score: Column, threshold: float) -> Column:
    return (score >= F.lit(threshold)).cast("int")


def mcc(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    tn, fp, fn, tp = (x.cast("double") for x in (tn, fp, fn, tp))
    return safe_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def hard_metrics(df: DataFrame, undefined: str = "zero") -> DataFrame:
    """Adds mcc, balanced_accuracy, precision, recall, specificity, f1_score to a table with the four counts.

    undefined: 'zero' or 'null' where a denominator is 0 (mcc is 0 in both).
    """
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    ratio = safe_ratio if undefined == "zero" else null_ratio
    out = df.withColumn("mcc", mcc(tn, fp, fn, tp)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("specificity", ratio(tn, tn + fp))
    out = out.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)
    if undefined == "zero":
        p, r = F.col("precision"), F.col("recall")
        return out.withColumn("f1_score", safe_ratio(2.0 * p * r, p + r))
    return out.withColumn("f1_score", null_ratio(2 * tp, 2 * tp + fp + fn))


def sweep(scored: DataFrame, score: str = "score", target: str = "target", groups: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, descending: cumulative tp and fp, and the four counts at that threshold.

    Without groups, sums run over range parts; with groups, a group's distinct scores meet.
    """
    ties = scored.groupBy(*groups, score).agg(F.sum(F.col(target).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    if not groups:
        r = running_sums(ties, [F.col(score).desc()], ["_p", "_n"])
        r = r.select(score, "_p", "_n", F.col("cum__p").alias("tp"), (F.col("cum__n") - F.col("cum__p")).alias("fp"), F.col("all__p").alias("_all_p"), (F.col("all__n") - F.col("all__p")).alias("_all_n"))
        return r.withColumn("fn", F.col("_all_p") - F.col("tp")).withColumn("tn", F.col("_all_n") - F.col("fp"))
    down = Window.partitionBy(*groups).orderBy(F.col(score).desc())
    whole = Window.partitionBy(*groups)
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ties.withColumn("tp", F.sum("_p").over(upto)).withColumn("fp", F.sum("_n").over(upto) - F.col("tp"))
    return out.withColumn("_all_p", F.sum("_p").over(whole)).withColumn("_all_n", F.sum("_n").over(whole) - F.col("_all_p")).withColumn("fn", F.col("_all_p") - F.col("tp")).withColumn("tn", F.col("_all_n") - F.col("fp"))


def best_threshold(scored: DataFrame, ties: str, score: str = "score", target: str = "target") -> DataFrame:
    """The threshold of highest MCC among all distinct scores and 'predict none' (a null threshold).

    ties: 'linear' (then balanced accuracy, F1, recall, nearness to 0.5, higher threshold) or
    'graph' (balanced accuracy, F1, recall, nearness to 0.5, lower threshold).
    """
    s = sweep(scored, score, target)
    none = s.limit(1).select(F.lit(None).cast("double").alias(score), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("_all_p").alias("fn"), F.col("_all_n").alias("tn"))
    m = hard_metrics(s.select(score, "tp", "fp", "fn", "tn").unionByName(none))
    t = F.coalesce(F.col(score), F.lit(float("inf")))
    r = lambda c: F.round(c, 12).desc()
    order = [r("mcc"), r("balanced_accuracy"), r("f1_score"), r("recall"), F.round(F.abs(t - 0.5), 12).asc(), t.desc() if ties == "linear" else t.asc()]
    return m.withColumn("search_boundaries", F.count(F.lit(1)).over(Window.partitionBy())).orderBy(*order).limit(1).withColumnRenamed(score, "threshold")


def best_grid_threshold(scored: DataFrame, points: int = 2001, score: str = "score", target: str = "target") -> DataFrame:
    """The best of evenly spaced thresholds in [0, 1]: MCC, balanced accuracy, nearness to 0.5, lower threshold.

    Scores are counted per grid cell first; each cell is then one row, so the grid costs the same
    whatever the number of scores.
    """
    n = points - 1
    cell = F.floor(F.col(score) * n).cast("long")
    cell = F.when(F.col(score) >= (cell + 1).cast("double") / n, cell + 1).when(F.col(score) < cell.cast("double") / n, cell - 1).otherwise(cell)
    ties = scored.select(F.least(F.greatest(cell, F.lit(-1)), F.lit(n)).alias("k"), F.col(target).cast("long").alias("y")).groupBy("k").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    grid = scored.sparkSession.range(-1, points).select(F.col("id").alias("k")).join(ties, "k", "left").select("k", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    up = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    c = grid.withColumn("tp", F.sum("p").over(up)).withColumn("fp", F.sum("n").over(up) - F.col("tp")).withColumn("fn", F.sum("p").over(whole) - F.col("tp")).withColumn("tn", F.sum("n").over(whole) - F.sum("p").over(whole) - F.col("fp"))
    m = hard_metrics(c.filter("k >= 0").withColumn("threshold", F.col("k").cast("double") / n))
    return m.orderBy(F.round("mcc", 12).desc(), F.round("balanced_accuracy", 12).desc(), F.round(F.abs(F.col("threshold") - 0.5), 12).asc(), F.col("threshold").asc()).limit(1)


def ranking(scored: DataFrame, score: str = "score", target: str = "target", groups: Sequence[str] = ()) -> DataFrame:
    """average_precision (stepwise), roc_auc (ties count half), brier_score; null where classes lack."""
    s = sweep(scored, score, target, groups)
    p, n = F.col("_all_p").cast("double"), F.col("_all_n").cast("double")
    ap = F.sum(F.when(p > 0, F.col("_p") / p * F.col("tp") / (F.col("tp") + F.col("fp"))))
    negatives = F.col("_n") - F.col("_p")
    area = F.sum(F.when(p * n > 0, (negatives * (F.col("tp") - F.col("_p")) + negatives * F.col("_p") / 2.0) / (p * n)))
    both = (F.max("_all_p") > 0) & (F.max("_all_n") > 0)
    sq = F.pow(F.col(score) - 1, 2) * F.col("_p") + F.pow(F.col(score), 2) * negatives
    return s.groupBy(*groups).agg(F.when(F.max("_all_p") > 0, ap).alias("average_precision"), F.when(both, area).alias("roc_auc"), (F.sum(sq) / F.sum("_n")).alias("brier_score"), F.sum("_n").alias("samples"), F.sum("_p").alias("positive_samples"))


def equal_count_bins(scored: DataFrame, row_id: str, bins: int = 20, score: str = "score", target: str = "target") -> DataFrame:
    """Reliability by equal-count bins of (score, row_id) order."""
    placed = positions(scored.select(row_id, score, target), [F.col(score).asc(), F.col(row_id).asc()], "_place")
    # the first `more` bins hold one row more than the others
    each, more = divmod(placed.count(), bins)
    at, cut = F.col("_place"), more * (each + 1)
    b = placed.withColumn("bin_index", F.when(at < cut, F.floor(at / (each + 1))).otherwise(more + F.floor((at - cut) / max(each, 1))).cast("int"))
    return b.groupBy("bin_index").agg(F.count(F.lit(1)).alias("sample_count"), F.min(score).alias("minimum_probability"), F.max(score).alias("maximum_probability"), F.avg(score).alias("mean_predicted_probability"), F.avg(F.col(target).cast("double")).alias("observed_positive_fraction"))


def equal_width_bins(scored: DataFrame, bins: int = 20, score: str = "score", target: str = "target") -> DataFrame:
    """Reliability by equal-width bins of [0, 1]; empty bins stay, with null means. A score on an edge goes up."""
    k = F.least(F.greatest(F.floor(F.col(score) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    got = scored.groupBy(k.alias("bin_index")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_probability"), F.avg(F.col(target).cast("double")).alias("observed_positive_rate"))
    edges = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin_index"), (F.col("id") / bins).alias("lower_bound"), ((F.col("id") + 1) / bins).alias("upper_bound"))
    return edges.join(got, "bin_index", "left").withColumn("sample_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def site_statistics(scored: DataFrame, site: str, threshold: float, score: str = "score", target: str = "target") -> DataFrame:
    """Per site: the four counts and the squared error. All resampling works on these."""
    return scored.groupBy(site).agg(*confusion_columns(F.col(target), hard(F.col(score), threshold)), F.sum(F.pow(F.col(score) - F.col(target), 2)).alias("squared_error"))


def breakdowns(facts: DataFrame, families: dict[str, str], target: Column, prediction: Column) -> DataFrame:
    """Counts per value of each family (name to column), all families in one pass of grouping sets."""
    renamed = facts.select(*[F.col(c).cast("string").alias(f"_f{i}") for i, c in enumerate(families.values())], target.alias("_y"), prediction.alias("_h"))
    keys = [f"_f{i}" for i in range(len(families))]
    out = renamed.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_g"), *confusion_columns(F.col("_y"), F.col("_h")))
    n = len(keys)
    family = value = None
    for i, name in enumerate(families):
        mine = F.col("_g") == F.lit((1 << n) - 1 - (1 << (n - 1 - i)))
        family = F.when(mine, name) if family is None else family.when(mine, name)
        value = F.when(mine, F.col(keys[i])) if value is None else value.when(mine, F.col(keys[i]))
    return out.select(family.alias("family"), value.alias("value"), *COUNTS)


def with_vocabulary(rows: DataFrame, known: DataFrame) -> DataFrame:
    """All known (family, value), with status REPRESENTED or NOT_REPRESENTED."""
    out = known.join(rows, ["family", "value"], "left")
    return out.withColumn("status", F.when(F.col("tn").isNull(), "NOT_REPRESENTED").otherwise("REPRESENTED"))


def hashed_draws(sites: DataFrame, site: str, replicates: int, seed: str, n_sites: int) -> DataFrame:
    """Bootstrap multiplicities (replicate, site, times) from digests alone: n draws per replicate with replacement.

    sites: (site, position from 0). A draw is a digest of (seed, replicate, draw number) modulo n.
    """
    spark = sites.sparkSession
    grid = spark.range(replicates).select(F.col("id").alias("replicate")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_sites - 1))))
    pick = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("replicate").cast("string"), F.col("draw").cast("string")), 256), 1, 12), 16, 10).cast("long") % n_sites
    times = grid.select("replicate", pick.alias("position")).groupBy("replicate", "position").agg(F.count(F.lit(1)).alias("times"))
    return times.join(sites, "position").select("replicate", site, "times")


def seeded_draws(spark: SparkSession, n_sites: int, replicates: int, seed: int) -> DataFrame:
    """Multiplicities (replicate, position, times) of numpy's PCG64 draws, made replicate by replicate on the tasks."""

    def draw(frames):
        import pandas as pd

        for pdf in frames:
            for r in pdf["id"]:
                got = np.random.Generator(np.random.PCG64([seed, int(r)])).integers(0, n_sites, n_sites)
                at, times = np.unique(got, return_counts=True)
                yield pd.DataFrame({"replicate": int(r), "position": at, "times": times})

    return spark.range(replicates).mapInPandas(draw, "replicate long, position long, times long")


def bootstrap(statistics: DataFrame, draws: DataFrame, site: str) -> DataFrame:
    """MCC per replicate from per-site counts and multiplicities."""
    met = draws.join(statistics, site)
    sums = met.groupBy("replicate").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in COUNTS])
    return sums.select("replicate", mcc(*[F.col(c) for c in COUNTS]).alias("mcc"))


def interval(values: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    return values.agg(F.percentile(column, F.lit(tail)).alias("ci_lower"), F.percentile(column, F.lit(1 - tail)).alias("ci_upper"), F.count(F.lit(1)).alias("replicates"))
