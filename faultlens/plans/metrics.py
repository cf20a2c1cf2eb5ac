"""Queries of classifier metrics over labelled documents: score least(1, n_chars / 2000), target quality."""

from pyspark.sql import functions as F

from faultlens.operators import metrics, ranks
from faultlens.plans.registry import query
from faultlens.sources.tables import table

THRESHOLD = 0.5
SCORED = "(select d.doc_id, d.source, d.lang, l.quality as target, l.toxic, least(1.0::double, d.n_chars::double / 2000.0::double) as score from labels l join documents d on d.doc_id = l.doc_id)"
SWEEP = f"""
ties as (select score, sum(target)::bigint as p, count(*) as n from {SCORED} group by score),
sw as (select score, p, n, (sum(p) over (order by score desc))::bigint as tp, (sum(n) over (order by score desc) - sum(p) over (order by score desc))::bigint as fp, (sum(p) over ())::bigint as ap, (sum(n) over () - sum(p) over ())::bigint as an from ties),
pts as (select score, tp, fp, ap - tp as fn, an - fp as tn from sw union all select null, 0, 0, any_value(ap), any_value(an) from sw)
"""


def measured(source: str) -> str:
    """The hard metrics of a table with the four counts, 0 where undefined."""
    return f"""(select *, (recall + specificity) / 2 as balanced_accuracy, case when precision + recall <> 0 then 2.0::double * precision * recall / (precision + recall) else 0.0::double end as f1_score from
 (select *, case when sqrt((tp + fp)::double * (tp + fn)::double * (tn + fp)::double * (tn + fn)::double) <> 0 then (tp::double * tn::double - fp::double * fn::double) / sqrt((tp + fp)::double * (tp + fn)::double * (tn + fp)::double * (tn + fn)::double) else 0.0::double end as mcc,
  case when tp + fp <> 0 then tp::double / (tp + fp) else 0.0::double end as precision, case when tp + fn <> 0 then tp::double / (tp + fn) else 0.0::double end as recall, case when tn + fp <> 0 then tn::double / (tn + fp) else 0.0::double end as specificity from {source}))"""


NAMES = ("mcc", "precision", "recall", "specificity", "balanced_accuracy", "f1_score")
ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in NAMES)


def scored(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return t.select("doc_id", "source", "lang", F.col("quality").alias("target"), "toxic", F.least(F.lit(1.0), F.col("n_chars") / F.lit(2000.0)).alias("score"))


def rounded(df, names=NAMES):
    return df.withColumns({c: F.round(c, 6) for c in names})


COUNTS = f"count(*) filter (target = 0 and score < {THRESHOLD}) as tn, count(*) filter (target = 0 and score >= {THRESHOLD}) as fp, count(*) filter (target = 1 and score < {THRESHOLD}) as fn, count(*) filter (target = 1 and score >= {THRESHOLD}) as tp"


@query(f"select source, {COUNTS} from {SCORED} group by source")
def confusion_counts(spark, d):
    return scored(spark, d).groupBy("source").agg(*metrics.confusion_columns(F.col("target"), metrics.hard(F.col("score"), THRESHOLD)))


@query(f"select source, tn, fp, fn, tp, {ROUNDED} from {measured(f'(select source, {COUNTS} from {SCORED} group by source)')}")
def hard_metrics_zero(spark, d):
    return rounded(metrics.hard_metrics(confusion_counts(spark, d), "zero"))


@query(f"""
select source, tn, fp, fn, tp, {ROUNDED} from (select *, (recall + specificity) / 2 as balanced_accuracy from (select *, case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) <> 0 then (tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)) else 0.0::double end as mcc,
 tp::double / nullif(tp + fp, 0) as precision, tp::double / nullif(tp + fn, 0) as recall, tn::double / nullif(tn + fp, 0) as specificity, (2 * tp)::double / nullif(2 * tp + fp + fn, 0) as f1_score from (select source, {COUNTS} from {SCORED} group by source)))
""")
def hard_metrics_null(spark, d):
    return rounded(metrics.hard_metrics(confusion_counts(spark, d), "null"))


BEST = "select round(score, 6) as threshold, tp, fp, fn, tn, (select count(*) from pts) as search_boundaries, round(mcc, 6) as mcc, round(balanced_accuracy, 6) as balanced_accuracy, round(f1_score, 6) as f1_score from {m} order by round(mcc, 12) desc, round(balanced_accuracy, 12) desc, round(f1_score, 12) desc, round(recall, 12) desc, round(abs(coalesce(score, 'inf'::double) - 0.5), 12) asc, coalesce(score, 'inf'::double) {o} limit 1"
PICKED = ["threshold", "tp", "fp", "fn", "tn", "search_boundaries", "mcc", "balanced_accuracy", "f1_score"]


def picked(df, names):
    return rounded(df.select(*names), [c for c in ("threshold", "mcc", "balanced_accuracy", "f1_score") if c in names])


@query(f"with {SWEEP} " + BEST.format(m=measured("pts"), o="desc"))
def threshold_linear(spark, d):
    return picked(metrics.best_threshold(scored(spark, d), "linear"), PICKED)


@query(f"with {SWEEP} " + BEST.format(m=measured("pts"), o="asc"))
def threshold_graph(spark, d):
    return picked(metrics.best_threshold(scored(spark, d), "graph"), PICKED)


@query(f"""
with g as (select i::double / 2000::double as threshold from range(2001) t(i)), s as {SCORED},
c as (select threshold, count(*) filter (target = 1 and score >= threshold) as tp, count(*) filter (target = 0 and score >= threshold) as fp, count(*) filter (target = 1 and score < threshold) as fn, count(*) filter (target = 0 and score < threshold) as tn from g, s group by threshold)
select round(threshold, 6) as threshold, tp, fp, fn, tn, round(mcc, 6) as mcc, round(balanced_accuracy, 6) as balanced_accuracy, round(f1_score, 6) as f1_score from {measured('c')}
order by round(mcc, 12) desc, round(balanced_accuracy, 12) desc, round(abs(threshold - 0.5), 12) asc, threshold asc limit 1
""")
def threshold_grid(spark, d):
    return picked(metrics.best_grid_threshold(scored(spark, d)), [c for c in PICKED if c != "search_boundaries"])


@query(f"""
with ties as (select source, score, sum(target)::bigint as p, count(*) as n from {SCORED} group by all),
sw as (select source, score, p, n, (sum(p) over w)::bigint as tp, (sum(n) over w - sum(p) over w)::bigint as fp, (sum(p) over (partition by source))::bigint as ap, (sum(n) over (partition by source) - sum(p) over (partition by source))::bigint as an from ties window w as (partition by source order by score desc))
select source, round(case when max(ap) > 0 then sum(p::double / ap * tp / (tp + fp)) end, 6) as average_precision, round(case when max(ap) > 0 and max(an) > 0 then sum(((n - p) * (tp - p) + (n - p) * p / 2.0::double) / (ap::double * an)) end, 6) as roc_auc,
 round(sum(power(score - 1, 2) * p + power(score, 2) * (n - p)) / sum(n), 6) as brier_score, sum(n)::bigint as samples, sum(p)::bigint as positive_samples from sw group by source
""")
def ranking_metrics(spark, d):
    return rounded(metrics.ranking(scored(spark, d), groups=["source"]), ("average_precision", "roc_auc", "brier_score"))


@query(f"select (b - 1)::int as bin_index, count(*) as sample_count, round(min(score), 6) as minimum_probability, round(max(score), 6) as maximum_probability, round(avg(score), 6) as mean_predicted_probability, round(avg(target::double), 6) as observed_positive_fraction from (select *, ntile(20) over (order by score, doc_id) as b from {SCORED}) group by b")
def reliability_equal_count(spark, d):
    return rounded(metrics.equal_count_bins(scored(spark, d), "doc_id"), ("minimum_probability", "maximum_probability", "mean_predicted_probability", "observed_positive_fraction"))


@query(f"select i::int as bin_index, round(i / 20.0::double, 6) as lower_bound, round((i + 1) / 20.0::double, 6) as upper_bound, round(m, 6) as mean_probability, round(r, 6) as observed_positive_rate, coalesce(n, 0) as sample_count from range(20) t(i) left join (select least(floor(score * 20), 19)::int as b, count(*) as n, avg(score) as m, avg(target::double) as r from {SCORED} group by 1) on b = i")
def reliability_equal_width(spark, d):
    return rounded(metrics.equal_width_bins(scored(spark, d)), ("lower_bound", "upper_bound", "mean_probability", "observed_positive_rate"))


@query(f"""
with s as {SCORED}, known as (select 'source' as family, source as value from (select distinct source from documents) union all select 'lang', lang from (select distinct lang from documents) union all select 'toxic', v from (values ('0'), ('1'), ('2')) t(v)),
got as (select 'source' as family, source as value, {COUNTS} from s group by source union all select 'lang', lang, {COUNTS} from s group by lang union all select 'toxic', toxic::varchar, {COUNTS} from s group by toxic)
select known.family, known.value, tn, fp, fn, tp, case when tn is null then 'NOT_REPRESENTED' else 'REPRESENTED' end as status from known left join got on got.family = known.family and got.value = known.value
""")
def breakdown_families(spark, d):
    rows = metrics.breakdowns(scored(spark, d), {"source": "source", "lang": "lang", "toxic": "toxic"}, F.col("target"), metrics.hard(F.col("score"), THRESHOLD))
    docs = table(spark, d, "documents")
    known = docs.select(F.lit("source").alias("family"), F.col("source").alias("value")).distinct().unionByName(docs.select(F.lit("lang").alias("family"), F.col("lang").alias("value")).distinct())
    known = known.unionByName(spark.range(3).select(F.lit("toxic").alias("family"), F.col("id").cast("string").alias("value")))
    return metrics.with_vocabulary(rows, known)


ORDERED = "(select o_custkey, case when o_orderstatus = 'F' then 1 else 0 end as target, least(1.0::double, o_totalprice / 400000.0::double) as score from orders)"


def ordered(spark, d):
    return table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("target"), F.least(F.lit(1.0), F.col("o_totalprice") / F.lit(400000.0)).alias("score"))


@query(f"select o_custkey, {COUNTS}, round(sum(power(score - target, 2)), 6) as squared_error from {ORDERED} group by o_custkey")
def site_statistics(spark, d):
    return metrics.site_statistics(ordered(spark, d), "o_custkey", THRESHOLD).withColumn("squared_error", F.round("squared_error", 6))


#: Replicates, as many as the reference takes.
REPLICATES = 1000
DRAWN = f"""
st as (select source as site, row_number() over (order by source) - 1 as position, {COUNTS} from {SCORED} group by source),
n as (select count(*) as n from st),
dr as (select rep, position, count(*) as times from (select r as rep, ('0x' || substr(sha256('draws|' || r::varchar || '|' || k::varchar), 1, 12))::bigint % n.n as position from n, (select r, unnest(range(n)) as k from n, range({REPLICATES}) a(r)) b) group by all),
su as (select rep as replicate, sum(times * tn)::bigint as tn, sum(times * fp)::bigint as fp, sum(times * fn)::bigint as fn, sum(times * tp)::bigint as tp from dr join st on st.position = dr.position group by rep)
"""


def bootstrapped(spark, d):
    st = metrics.site_statistics(scored(spark, d), "source", THRESHOLD)
    placed = ranks.positions(st.select("source"), [F.col("source").asc_nulls_last()], "position")
    n = st.count()
    return metrics.bootstrap(st, metrics.hashed_draws(placed, "source", REPLICATES, "draws", n), "source")


@query(f"with {DRAWN} select replicate, round(mcc, 6) as mcc from {measured('su')}")
def bootstrap_replicates(spark, d):
    return rounded(bootstrapped(spark, d), ["mcc"])


@query(f"with {DRAWN} select round(quantile_cont(mcc, 0.025), 6) as ci_lower, round(quantile_cont(mcc, 0.975), 6) as ci_upper, count(*) as replicates from {measured('su')}")
def bootstrap_interval(spark, d):
    return rounded(metrics.interval(bootstrapped(spark, d), "mcc"), ["ci_lower", "ci_upper"])


@query()
def seeded_bootstrap(spark, d):
    st = metrics.site_statistics(scored(spark, d), "source", THRESHOLD)
    position = ranks.positions(st.select("source"), [F.col("source").asc_nulls_last()], "position")
    draws = metrics.seeded_draws(spark, position.count(), REPLICATES, 20260909).join(position, "position").select("replicate", "source", "times")
    return metrics.interval(metrics.bootstrap(st, draws, "source"), "mcc")


@query(f"select min(v) as vec_min, max(v) as vec_max, count(*) filter (v > 0) as n_positive, count(*) as n from (select source, round(avg(target::double) - avg(score), 6) as v from {SCORED} group by source)")
def group_extremes(spark, d):
    g = scored(spark, d).groupBy("source").agg(F.round(F.avg(F.col("target").cast("double")) - F.avg("score"), 6).alias("v"))
    return g.agg(F.min("v").alias("vec_min"), F.max("v").alias("vec_max"), F.count_if(F.col("v") > 0).alias("n_positive"), F.count(F.lit(1)).alias("n"))
