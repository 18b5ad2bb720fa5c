"""Models on aligned rows, and the baselines they are compared with.

The integrated model is fitted once on all institutions' training rows with Spark ML and evaluated by institution. Models that stay
inside one institution are small numpy fits in a grouped map. ``mlp`` is a relu layer of 256 units that stops early, trained in parts whose
parameters are averaged. ``svm`` and ``svm_linear`` are the exact machines of ``machines``, with probabilities from held-out folds. Where they would have too many
support vectors, ``svm_fourier`` adds Fourier features of the RBF kernel before Spark ML's linear machine; its margins become probabilities by a logistic fit for each class.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stable
from . import federated, machines, metrics
from .reduce import matrix

MODELS = ("softmax", "random_forest", "svm_linear", "svm", "svm_fourier", "mlp", "linear_regression", "gbt_regression")
FOURIER = 200


def scaled(train: DataFrame, rows: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Standard scores by the training rows (population deviation, 0 taken as 1), weighted by direction if asked."""
    long = train.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = sorted(long.collect(), key=lambda r: r["i"])  # one row per dimension
    w = np.ones(len(stats)) if weights is None else np.resize(weights, len(stats))
    mean, factor = F.lit([float(r["m"]) for r in stats]), F.lit([float(w[r["i"]] / (r["s"] or 1.0)) for r in stats])
    z = F.zip_with(F.zip_with("features", mean, lambda x, m: x - m), factor, lambda x, f: x * f)
    return rows.withColumn("features", z)


def fourier(rows: DataFrame, n_features: int, gamma: float, seed: int = 0, n: int = FOURIER) -> DataFrame:
    """Random Fourier features: their inner products approximate the RBF kernel."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(n, n_features)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, n)
    terms = F.array(*[F.struct(F.lit([float(v) for v in row]).alias("w"), F.lit(float(c)).alias("b")) for row, c in zip(w, b, strict=True)])
    from ..functions.expressions import dot

    return rows.withColumn("features", F.transform(terms, lambda t: F.sqrt(F.lit(2.0 / n)) * F.cos(dot(F.col("features"), t["w"]) + t["b"])))


def fit_and_score(train: DataFrame, test: DataFrame, model: str, n_classes: int, seed: int = 0, c: float = 1.0, weights: np.ndarray | None = None) -> DataFrame:
    """The test rows with ``scores`` (an array over classes; one element for regression) and ``predicted``."""
    train, test = train.filter(F.col("target").isNotNull()), test
    train_z, test_z = scaled(train, train, weights), scaled(train, test, weights)
    if model in ("svm", "svm_linear"):
        return machines.machine_scores(train_z, test_z, n_classes, "rbf" if model == "svm" else "linear", c)
    if model == "svm_fourier":
        d = len(train.select("features").first()[0])
        train_z, test_z = stable(fourier(train_z, d, 1 / d, seed)), stable(fourier(test_z, d, 1 / d, seed))  # read by every class
    ready = lambda rows: rows.withColumn("x", array_to_vector("features")).withColumn("y", F.col("target").cast("double"))
    train_x, test_x = ready(train_z), ready(test_z)
    common = {"featuresCol": "x", "labelCol": "y"}
    if model == "softmax":
        n = max(train.count(), 1)
        est = LogisticRegression(family="multinomial", regParam=1 / (c * n), standardization=False, maxIter=200, **common)
    elif model == "random_forest":
        est = RandomForestClassifier(numTrees=100, maxDepth=12, seed=seed, **common)
    elif model == "svm_fourier":
        est = OneVsRest(classifier=LinearSVC(regParam=1 / (c * max(train.count(), 1)), maxIter=100, standardization=False), rawPredictionCol="rawPrediction", parallelism=n_classes, **common)  # a round is a small job: classes share the cluster
    elif model == "mlp":
        return federated.relu_network(train_z, test_z, n_classes, seed)
    elif model in ("linear_regression", "gbt_regression"):
        est = LinearRegression(solver="normal", **common) if model == "linear_regression" else GBTRegressor(maxIter=30, seed=seed, **common)
        out = est.fit(train_x).transform(test_x)
        return out.withColumn("scores", F.array("prediction")).withColumn("predicted", F.col("prediction")).drop("x", "y", "prediction")
    else:
        raise ValueError(f"unknown model {model!r}: one of {MODELS}")
    fitted = est.fit(train_x)
    out = fitted.transform(test_x)
    if model == "svm_fourier":
        p = margin_probabilities(fitted.transform(train_x), out, n_classes)
        return p.withColumn("predicted", F.col("prediction").cast("int")).select(*test.columns, "scores", "predicted")
    raw = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn("scores", vector_to_array(raw)).withColumn("predicted", F.col("prediction").cast("int")).select(*test.columns, "scores", "predicted")


def margin_probabilities(train: DataFrame, rows: DataFrame, n_classes: int) -> DataFrame:
    """``rows`` with ``scores``: each class's margin through a logistic fit on the training margins, scaled to sum to one."""
    fits, train = [], stable(train.select("rawPrediction", "y"))
    for c in range(n_classes):
        own = lambda df, c=c: df.withColumn("__m", array_to_vector(F.array(vector_to_array("rawPrediction")[c])))
        both = own(train).select("__m", (F.col("y") == c).cast("double").alias("__y"))
        model = LogisticRegression(featuresCol="__m", labelCol="__y", maxIter=50).fit(both)
        fits.append((float(model.coefficients[0]), float(model.intercept)))
    margins = vector_to_array("rawPrediction")
    each = F.array(*[1 / (1 + F.exp(-(F.lit(a) * margins[c] + F.lit(b)))) for c, (a, b) in enumerate(fits)])
    out = rows.withColumn("__p", each)
    total = F.aggregate("__p", F.lit(0.0), lambda s, v: s + v)
    return out.withColumn("scores", F.transform("__p", lambda v: v / F.greatest(total, F.lit(1e-300)))).drop("__p")


def evaluate(scored: DataFrame, metric: str, n_classes: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, score. auc: binary, or the mean of one against the rest."""
    if metric == "auc":
        if n_classes == 2:
            found = metrics.auc_binary(scored.withColumn("__s", F.col("scores")[1]), "target", "__s", keys)
        else:
            found = metrics.auc_one_vs_rest(scored, "target", "scores", n_classes, keys)
        return found.select(*keys, F.col("auc").alias("score"))
    if metric == "accuracy":
        return metrics.accuracy(scored, "target", "predicted", keys).select(*keys, F.col("accuracy").alias("score"))
    if metric in ("rmse", "r2"):
        return metrics.rmse_r2(scored, "target", "predicted", keys).select(*keys, F.col(metric).alias("score"))
    raise ValueError(f"unknown metric {metric!r}")


def softmax_fit(x: np.ndarray, y: np.ndarray, n_classes: int, c: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial regression with an L2 penalty of 1 / (c n), by accelerated gradient steps. For one institution's rows."""
    n, d = x.shape
    onehot = (y[:, None] == np.arange(n_classes)).astype(float)
    step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 / n + 0.5 + 1 / (c * n))
    w, b = np.zeros((d, n_classes)), np.zeros(n_classes)
    ww, bb, t = w, b, 1.0
    for _ in range(rounds):
        z = x @ ww + bb
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new_w, new_b = ww - step * (x.T @ (p - onehot) / n + ww / (c * n)), bb - step * (p - onehot).mean(axis=0)
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ww, bb = new_w + (old - 1) / t * (new_w - w), new_b + (old - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return w, b


def _own(rows: pd.DataFrame, n_classes: int) -> pd.DataFrame:
    train, test = rows[rows["part"] == "train"], rows[rows["part"] == "test"]
    x, z = matrix(train["features"]), matrix(test["features"])
    mean, s = x.mean(axis=0), x.std(axis=0)
    s[s == 0] = 1
    w, b = softmax_fit((x - mean) / s, train["target"].to_numpy(), n_classes)
    scores = (z - mean) / s @ w + b
    return test[["institution", "row_id", "target"]].assign(scores=list(scores), predicted=scores.argmax(axis=1).astype(np.int32))


def individual(rows: DataFrame, n_classes: int) -> DataFrame:
    """Each institution's test rows, scored by a model of its own training rows alone."""
    own = rows.filter(F.col("part").isin("train", "test")).select("institution", "part", "row_id", "target", "features")
    return own.groupBy("institution").applyInPandas(partial(_own, n_classes=n_classes), "institution int, row_id long, target int, scores array<double>, predicted int")
