import numpy as np
import pytest

from faultlens.operators import metrics, models


def scored(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    return y, p, spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id int, target int, score double")


def mcc(y, h):
    tp, fp, fn, tn = (y & h).sum(), ((1 - y) & h).sum(), (y & (1 - h)).sum(), ((1 - y) & (1 - h)).sum()
    d = np.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (tp * tn - fp * fn) / d if d else 0.0


def test_threshold_is_the_best_of_all(spark):
    y, p, df = scored(spark)
    got = metrics.best_threshold(df, "linear").first()
    assert got.mcc == pytest.approx(max(mcc(y, (p >= t).astype(int)) for t in np.unique(p)))
    assert got.search_boundaries == len(np.unique(p)) + 1
    grid = metrics.best_grid_threshold(df, 2001).first()
    assert grid.mcc == pytest.approx(max(mcc(y, (p >= t).astype(int)) for t in np.linspace(0, 1, 2001)))


def test_areas_by_brute_force(spark):
    y, p, df = scored(spark)
    r = metrics.ranking(df).first()
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in p[y == 1] for b in p[y == 0]]
    assert r.roc_auc == pytest.approx(np.mean(pairs))
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        h = p >= t
        recall = (y[h] == 1).sum() / y.sum()
        ap += (recall - last) * (y[h] == 1).mean()
        last = recall
    assert r.average_precision == pytest.approx(ap)
    assert r.brier_score == pytest.approx(np.mean((p - y) ** 2))


def test_one_class_has_no_roc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "target int, score double")
    r = metrics.ranking(df).first()
    assert r.roc_auc is None and r.average_precision == 1.0


def test_equal_width_edges(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 0.25), (0, 0.249)], "target int, score double")
    n = {r.bin_index: r.sample_count for r in metrics.equal_width_bins(df).collect()}
    assert n[0] == 1 and n[19] == 1 and n[5] == 1 and n[4] == 1 and sum(n.values()) == 4


def test_seeded_draws_repeat(spark):
    a = metrics.seeded_draws(spark, 10, 5, 3)
    assert models.same_rows(a, metrics.seeded_draws(spark, 10, 5, 3))
    assert [r["n"] for r in a.groupBy("replicate").agg({"times": "sum"}).withColumnRenamed("sum(times)", "n").collect()] == [10] * 5


def test_perceptron_learns_and_repeats(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 2))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(float)
    m = models.Perceptron([2, 16, 8, 1], seed=3).fit(x, y, epochs=60, batch=128, rate=0.01)
    assert (((m.predict(x) > 0.5) == y).mean()) > 0.9
    again = models.Perceptron([2, 16, 8, 1], seed=3).fit(x, y, epochs=60, batch=128, rate=0.01)
    assert np.array_equal(m.predict(x), again.predict(x))
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x[:50])], "id int, v array<double>")
    got = [r.score for r in models.score_batches(df, "v", m).orderBy("id").collect()]
    assert np.allclose(got, m.predict(x[:50]))


def test_logistic_separates(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(rng.normal()), int(a > 0)) for a in x], "a double, b double, y int")
    model, vector = models.fit_logistic(df, ["a", "b"], "y", penalty=1e-5)
    assert model.transform(vector.transform(df)).filter("prediction = y").count() > 290


def test_balanced_epochs():
    y = np.array([1.0] * 30 + [0.0] * 970)
    order = models.balanced_epoch_order(y, 5)
    assert set(range(1000)) <= set(order.tolist()) and len(order) == 1940 and y[order].sum() == 970
    assert abs(y[order[:200]].mean() - 0.5) < 0.15  # shuffled
    assert sorted(models.balanced_epoch_order(np.zeros(4), 0)) == [0, 1, 2, 3]
    x = np.random.default_rng(1).normal(size=(1000, 2)) + y[:, None] * 1.5
    p = models.Perceptron([2, 16, 1], seed=3).fit(x, y, epochs=20, batch=128, rate=0.01).predict(x)
    assert (p[y == 1] > 0.5).mean() > 0.7  # a fit on rows as they are predicts hardly any


def test_perceptron_fit_takes_its_bound(spark, data):
    from faultlens.plans import models as plans

    few, all_ = (plans.perceptron_fit(spark, data, *n) for n in ((20,), ()))
    assert few.count() == all_.count()
    assert few.agg({"score": "sum"}).first()[0] != all_.agg({"score": "sum"}).first()[0]
