"""Queries of models, baselines, comparisons and acceptance."""

from pyspark.sql import functions as F

from faultlens.operators import metrics, models, rows
from faultlens.plans.metrics import SCORED, measured, rounded, scored
from faultlens.plans.registry import query
from faultlens.sources.tables import table

W1 = [[0.5, -0.25], [-0.75, 1.0], [0.1, 0.2]]
B1 = [0.1, -0.2, 0.0]
W2 = [[1.0, -1.5, 0.7]]
B2 = [0.05]


def _dense(row, bias, names):
    return " + ".join([f"{bias}::double", *[f"{w}::double * {n}" for w, n in zip(row, names, strict=True)]])


HIDDEN = ", ".join(f"greatest({_dense(w, b, ('p', 's'))}, 0.0::double) as h{k}" for k, (w, b) in enumerate(zip(W1, B1, strict=True)))


@query(f"select p_partkey, round(1.0::double / (1.0::double + exp(-({_dense(W2[0], B2[0], ('h0', 'h1', 'h2'))}))), 6) as score from (select p_partkey, {HIDDEN} from (select p_partkey, p_size / 50.0::double as p, p_retailprice / 2000.0::double as s from part))")
def mlp_forward(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("p"), (F.col("p_retailprice") / 2000.0).alias("s"))
    z = models.layer(models.layer([F.col("p"), F.col("s")], W1, B1), W2, B2, relu=False)[0]
    return p.select("p_partkey", F.round(1.0 / (1.0 + F.exp(-z)), 6).alias("score"))


@query("select p_partkey, round(1.0::double / (1.0::double + exp(-(0.3::double + 0.8::double * (p_size / 50.0::double) - 0.4::double * (p_retailprice / 2000.0::double)))), 6) as score from part")
def logistic_forward(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("p"), (F.col("p_retailprice") / 2000.0).alias("s"))
    return models.logistic_score(p, [0.8, -0.4], 0.3, ["p", "s"]).select("p_partkey", F.round("score", 6).alias("score"))


def features(spark, d):
    s = scored(spark, d)
    return s.select("doc_id", "target", "score", F.log1p("score").alias("log_score"), (F.col("lang") == "en").cast("double").alias("is_en"), F.col("toxic").cast("double").alias("toxic"))


@query()
def logistic_fit(spark, d):
    f = features(spark, d)
    model, vector = models.fit_logistic(f, ["score", "log_score", "is_en", "toxic"], "target")
    return model.transform(vector.transform(f)).select("doc_id", "target", F.col("prediction").cast("int").alias("prediction"))


#: Rows the perceptron is fitted on, at most: those of least digest. The fit runs on the driver.
FIT_ROWS = 20_000


@query()
def perceptron_fit(spark, d, fit_rows=FIT_ROWS):
    import numpy as np

    f = features(spark, d)
    sample = f.orderBy(F.xxhash64("doc_id")).limit(fit_rows).select("target", "score", "log_score", "is_en", "toxic").toPandas()
    model = models.Perceptron([4, 16, 8, 1], seed=7).fit(sample[["score", "log_score", "is_en", "toxic"]].to_numpy(), sample["target"].to_numpy(np.float64), epochs=8, batch=256, rate=0.01)
    out = f.select("doc_id", "target", F.array("score", "log_score", "is_en", "toxic").alias("x"))
    return models.score_batches(out, "x", model).select("doc_id", "target", "score")


@query(f"select target, round(a / (2.0::double * n), 6) as weight from (select target, count(*) as n, sum(count(*)) over () as a from {SCORED} group by target)")
def class_weights(spark, d):
    return models.class_weights(scored(spark, d), "target").withColumn("weight", F.round("weight", 6))


U = "('0x' || substr(sha256('{s}|' || doc_id::varchar), 1, 12))::bigint::double / 281474976710656::double"


@query(f"""
with s as {SCORED}, n as (select greatest(1.0::double, count(*) filter (target = 1)::double / greatest(count(*) filter (target = 0), 1)) as r from s)
select doc_id, case when target = 0 then floor(r)::int + case when {U.format(s='epoch')} < r - floor(r) then 1 else 0 end else 1 end as copies from s, n
""")
def balanced_copies(spark, d):
    rare = scored(spark, d).withColumn("rare", 1 - F.col("target"))
    return models.balanced_copies(rare, "rare", "doc_id", "epoch").select("doc_id", "copies")


@query(f"select doc_id, case when {U.format(s='dummy')} < 0.85::double then 1 else 0 end as prediction from {SCORED}")
def stratified_dummy(spark, d):
    return models.stratified_random(scored(spark, d), "doc_id", 0.85, "dummy").select("doc_id", "prediction")


@query(f"select case when avg(target::double) > 0.5 then 1 else 0 end as prediction from {SCORED}")
def majority_dummy(spark, d):
    return models.majority(scored(spark, d), "target")


THRESHOLDS = {"hybrid": 0.25, "gnn": 0.5, "logistic": 0.75}
MEASURES = ("mcc", "balanced_accuracy", "recall", "f1_score")
MODELS_SQL = "(" + " union all ".join(f"select '{m}' as model, count(*) filter (target = 0 and score < {t}) as tn, count(*) filter (target = 0 and score >= {t}) as fp, count(*) filter (target = 1 and score < {t}) as fn, count(*) filter (target = 1 and score >= {t}) as tp from {SCORED}" for m, t in THRESHOLDS.items()) + ")"
LONG = f"(select model, measure, value from (unpivot (select model, mcc, balanced_accuracy, recall, f1_score from {measured(MODELS_SQL)}) on mcc, balanced_accuracy, recall, f1_score into name measure value value))"


def per_model(spark, d, *groups):
    s = scored(spark, d)
    long = s.select("target", "score", *groups, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("t")) for m, t in THRESHOLDS.items()])).alias("m"))
    return metrics.hard_metrics(long.groupBy("m.model", *groups).agg(*metrics.confusion_columns(F.col("target"), (F.col("score") >= F.col("m.t")).cast("int"))))


@query(f"select b.measure, o.model, round(b.value, 6) as base_value, round(o.value, 6) as value, round(b.value - o.value, 6) as delta from {LONG} b join {LONG} o on o.measure = b.measure and b.model = 'hybrid' and o.model <> 'hybrid'")
def model_comparison(spark, d):
    return rounded(models.comparison(per_model(spark, d), "hybrid", ["gnn", "logistic"], MEASURES), ("base_value", "value", "delta"))


CRITERIA = [("positive_mcc", "validity", ">", 0.0), ("balanced_accuracy", "validity", ">", 0.5), ("absolute_mcc", "performance", ">=", 0.4), ("absolute_f1", "performance", ">=", 0.6), ("absolute_recall", "performance", ">=", 0.7)]
ACTUALS = {"positive_mcc": "mcc", "balanced_accuracy": "balanced_accuracy", "absolute_mcc": "mcc", "absolute_f1": "f1_score", "absolute_recall": "recall"}


@query("select criterion, family, round(actual, 6) as actual, operator, required::double as required, case operator when '>' then actual > required else actual >= required end as passed from (" + " union all ".join(f"select '{c}' as criterion, '{f}' as family, {ACTUALS[c]} as actual, '{o}' as operator, {r}::double as required from {measured(MODELS_SQL)} where model = 'hybrid'" for c, f, o, r in CRITERIA) + ")")
def acceptance_rows(spark, d):
    m = per_model(spark, d).filter("model = 'hybrid'")
    actual = m.selectExpr(f"stack({len(ACTUALS)}, " + ", ".join(f"'{c}', {v}" for c, v in ACTUALS.items()) + ") as (criterion, actual)")
    criteria = spark.createDataFrame(CRITERIA, "criterion string, family string, operator string, required double")
    return rows.verdicts(actual, criteria).withColumn("actual", F.round("actual", 6))


@query("""
select h.source, round(h.mcc - g.mcc, 6) as delta_mcc, round(h.recall - g.recall, 6) as delta_recall from {a} h join {a} g on g.source = h.source and h.model = 'hybrid' and g.model = 'gnn'
""".replace("{a}", measured("(" + " union all ".join(f"select '{m}' as model, source, count(*) filter (target = 0 and score < {t}) as tn, count(*) filter (target = 0 and score >= {t}) as fp, count(*) filter (target = 1 and score < {t}) as fn, count(*) filter (target = 1 and score >= {t}) as tp from {SCORED} group by source" for m, t in THRESHOLDS.items() if m != "logistic") + ")")))
def subgroup_deltas(spark, d):
    m = per_model(spark, d, "source")
    side = lambda name, p: m.filter(F.col("model") == name).select("source", F.col("mcc").alias(f"{p}_mcc"), F.col("recall").alias(f"{p}_recall"))
    met = side("hybrid", "h").join(side("gnn", "g"), "source")
    return met.select("source", F.round(F.col("h_mcc") - F.col("g_mcc"), 6).alias("delta_mcc"), F.round(F.col("h_recall") - F.col("g_recall"), 6).alias("delta_recall"))


@query(f"select h.prediction as hybrid, g.prediction as gnn, count(*) as n, sum(h.target)::bigint as positives from (select doc_id, target, (score >= 0.25)::int as prediction from {SCORED}) h join (select doc_id, (score >= 0.5)::int as prediction from {SCORED}) g using (doc_id) group by 1, 2")
def paired_predictions(spark, d):
    s = scored(spark, d)
    h = s.select("doc_id", "target", metrics.hard(F.col("score"), 0.25).alias("hybrid"))
    g = s.select("doc_id", metrics.hard(F.col("score"), 0.5).alias("gnn"))
    return h.join(g, "doc_id").groupBy("hybrid", "gnn").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("positives"))
