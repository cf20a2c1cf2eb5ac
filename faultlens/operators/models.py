"""Linear models, multilayer perceptrons, baselines, balanced sampling and comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star_vectors(facts: DataFrame, dims: Sequence[tuple[DataFrame, str, str]], lead: Sequence[str]) -> DataFrame:
    """Dense vectors put together late: [lead columns | features of each dimension], (.., vector).

    dims: (dimension, key, array column). The optimizer broadcasts a dimension that is small enough.
    """
    out = facts
    for k, (dim, key, column) in enumerate(dims):
        out = out.join(dim.select(key, F.col(column).alias(f"_d{k}")), key)
    parts = [F.array(*[F.col(c).cast("double") for c in lead])] + [F.col(f"_d{k}").cast("array<double>") for k in range(len(dims))]
    return out.withColumn("vector", F.concat(*parts)).drop(*[f"_d{k}" for k in range(len(dims))])


def z_scored(df: DataFrame, column: str, fit: Column, name: str) -> DataFrame:
    """(x - mean) / population deviation, both from rows where fit holds; a column constant there is an error, as it can't be scaled."""
    stats = df.filter(fit).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.raise_error(F.lit(f"{column} is constant where the scaler is fitted")))
    return df.crossJoin(F.broadcast(stats)).withColumn(name, (F.col(column) - F.col("_m")) / scale).drop("_m", "_s")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(target, weight): rows / (2 * rows of the class)."""
    per = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"))
    return per.crossJoin(F.broadcast(total)).select(target, (F.col("_all") / (2.0 * F.col("_n"))).alias("weight"))


def balanced_copies(df: DataFrame, target: str, key: str, seed: str) -> DataFrame:
    """Rows with `copies`: every negative once; positives so often that their number (nearly) matches.

    A positive has floor(rate) copies and one more if its digest falls under the rest: a replication
    that each row decides alone.
    """
    n = df.agg(F.count_if(F.col(target) == 1).alias("_p"), F.count_if(F.col(target) == 0).alias("_n"))
    rate = F.greatest(F.lit(1.0), F.col("_n") / F.greatest(F.col("_p"), F.lit(1)))
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    copies = F.when(F.col(target) == 1, F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).otherwise(1)
    return df.crossJoin(F.broadcast(n)).withColumn("copies", copies.cast("int")).drop("_p", "_n")


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """A seeded permutation per epoch."""
    return df.withColumn("_o", F.xxhash64(F.col(key), F.lit(seed + epoch))).orderBy("_o", key).drop("_o")


def fit_logistic(df: DataFrame, features: Sequence[str], target: str, penalty: float = 1e-4, weight: str | None = None):
    """L2 logistic regression: (model, the pipeline's vector column is 'features')."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    extra = {"weightCol": weight} if weight else {}
    return LogisticRegression(labelCol=target, featuresCol="features", regParam=penalty, maxIter=50, **extra).fit(vector.transform(df)), vector


def logistic_score(df: DataFrame, coefficients: Sequence[float], intercept: float, features: Sequence[str]) -> DataFrame:
    """Probability of fixed weights, as an expression."""
    z = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(c) for w, c in zip(coefficients, features, strict=True)], F.lit(float(intercept)))
    return df.withColumn("score", 1.0 / (1.0 + F.exp(-z)))


def balanced_epoch_order(y: np.ndarray, seed: int) -> np.ndarray:
    """Row numbers of an epoch, shuffled: all rows, and rows of the rarer class drawn with replacement until both match."""
    rng = np.random.Generator(np.random.PCG64(seed))
    one, zero = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    rare, lacking = (one, len(zero) - len(one)) if len(one) < len(zero) else (zero, len(one) - len(zero))
    more = rng.choice(rare, lacking) if len(rare) and lacking else rare[:0]
    return rng.permutation(np.concatenate([one, zero, more]))


class Perceptron:
    """ReLU layers with a logistic output, trained by Adam on balanced mini-batches."""

    def __init__(self, sizes: Sequence[int], seed: int = 0) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.w = [rng.uniform(-1, 1, (a, b)) * np.sqrt(6.0 / (a + b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.seed = seed

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if k + 1 < len(self.w) else 1 / (1 + np.exp(-np.clip(z, -60, 60))))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(np.asarray(x, np.float64))[-1][:, 0]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 8192, rate: float = 1e-3, penalty: float = 1e-4) -> Perceptron:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        m = [np.zeros_like(p) for p in (*self.w, *self.b)]
        v = [np.zeros_like(p) for p in m]
        step = 0
        for epoch in range(epochs):
            order = balanced_epoch_order(y, self.seed + epoch)
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                layers = self.forward(x[at])
                delta = (layers[-1] - y[at, None]) / len(at)
                gw, gb = [], []
                for k in range(len(self.w) - 1, -1, -1):
                    gw.insert(0, layers[k].T @ delta + penalty * self.w[k] / len(at))
                    gb.insert(0, delta.sum(axis=0))
                    if k:
                        delta = (delta @ self.w[k].T) * (layers[k] > 0)
                step += 1
                for p, g, a, s in zip((*self.w, *self.b), (*gw, *gb), m, v, strict=True):
                    a += 0.1 * (g - a)
                    s += 0.001 * (g * g - s)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self


def score_batches(df: DataFrame, features: str, model: Perceptron) -> DataFrame:
    """Adds score, batch by batch; a score outside [0, 1] is an error."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("score", DoubleType())])

    def run(frames):
        for pdf in frames:
            p = model.predict(np.array(pdf[features].tolist(), np.float64).reshape(len(pdf), -1)) if len(pdf) else np.empty(0)
            if not ((p >= 0) & (p <= 1)).all():
                raise ValueError("a score lies outside [0, 1]")
            yield pdf.assign(score=p)

    return df.mapInPandas(run, schema)


def layer(values: Sequence[Column], weights: Sequence[Sequence[float]], bias: Sequence[float], relu: bool = True) -> list[Column]:
    """A dense layer of fixed weights, as expressions: weights[out][in]."""
    out = []
    for row, b in zip(weights, bias, strict=True):
        z = reduce(lambda a, c: a + c, [F.lit(float(w)) * v for w, v in zip(row, values, strict=True)], F.lit(float(b)))
        out.append(F.greatest(z, F.lit(0.0)) if relu else z)
    return out


def majority(df: DataFrame, target: str) -> DataFrame:
    """The constant prediction of the more frequent class (0 at a tie), as one row."""
    return df.agg((F.avg(F.col(target).cast("double")) > 0.5).cast("int").alias("prediction"))


def stratified_random(df: DataFrame, key: str, prevalence: float, seed: str) -> DataFrame:
    """A prediction drawn at the prevalence from each row's digest."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return df.withColumn("prediction", (u < prevalence).cast("int"))


def comparison(metrics: DataFrame, base: str, others: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(measure, model, base_value, value, delta) from metrics (model, measures...)."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in measures)
    long = metrics.selectExpr("model", f"stack({len(measures)}, {pairs}) as (measure, value)")
    b = long.filter(F.col("model") == base).select("measure", F.col("value").alias("base_value"))
    return long.filter(F.col("model").isin(*others)).join(b, "measure").withColumn("delta", F.col("base_value") - F.col("value"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two runs gave the same rows."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
