"""Nonlinear reductions of pooled rows: a layout of the neighbour graph, and an autoencoder.

The layout keeps near rows near. Each row's distances to its k nearest become weights that fall off from its nearest neighbour on and add up to log2 k; both directions of
an edge are united as fuzzy sets, and with labels an edge between classes is weakened. From the principal components on, each round moves every row by its
edges' attraction and the repulsion of a few hashed partners, and is one job of joins on positions: no task holds the graph. New rows lie at the weighted mean of
their nearest neighbours' places.

The autoencoder encodes x as x V + tanh(x A + a) B and decodes z as z V' + tanh(z B' + c) A', with the same matrices both ways. It starts as the principal components (B = 0)
and takes quasi-Newton steps with gradients that tasks add up; the best parameters are kept, so its error is never above that of the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as la
from ..session import saved, stable
from .heads import lbfgs
from .neighbours import nearest_rows
from .ranking import global_row_number
from .reduce import MAX_TASKS, gram_sums, matrix, reduce_pooled

#: Partners that push a row away in a round, their weight for each unit of an edge's, and the farthest a force moves.
PARTNERS, REPULSION, FARTHEST = 5, 5.0, 4.0


def curve(min_distance: float, spread: float = 1.0, rounds: int = 200) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + a d^2b) is nearest to 1 up to ``min_distance`` and an exponential beyond."""
    d = np.linspace(1e-3, 3 * spread, 300)
    goal = np.where(d < min_distance, 1.0, np.exp(-(d - min_distance) / spread))
    at = np.array([1.0, 1.0])
    for _ in range(rounds):
        power = d ** (2 * at[1])
        f = 1 / (1 + at[0] * power)
        j = np.stack([-power * f * f, -at[0] * power * 2 * np.log(d) * f * f], axis=1)
        at = np.maximum(at - 0.5 * np.linalg.solve(j.T @ j + 1e-9 * np.eye(2), j.T @ (f - goal)), 1e-3)
    return float(at[0]), float(at[1])


def _memberships(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weights of each row's edges: exp(-(d - nearest) / s), s such that they add up to log2 k; each edge both ways round. All rows of a frame search their s side by side."""
    for f in frames:
        if not len(f):
            continue
        size = f["others"].map(len).to_numpy()
        there = np.arange(size.max())[None, :] < size[:, None]
        d = np.zeros(there.shape)
        d[there] = np.sqrt(np.concatenate(f["squares"].tolist()).astype(float))
        nearest, goal = np.where(there & (d > 0), d, np.inf).min(axis=1), np.log2(np.maximum(size, 2))
        apart = np.maximum(d - np.where(np.isfinite(nearest), nearest, d.max(axis=1))[:, None], 0)
        weights = lambda s: np.where(there, np.exp(-apart / s[:, None]), 0)
        lo, hi, s, open_ = np.zeros(len(f)), np.full(len(f), np.inf), np.ones(len(f)), np.ones(len(f), bool)
        for _ in range(64):
            total = weights(s).sum(axis=1)
            open_ &= np.abs(total - goal) >= 1e-5
            if not open_.any():
                break
            above = total > goal
            lo, hi = np.where(open_ & ~above, s, lo), np.where(open_ & above, s, hi)
            with np.errstate(invalid="ignore"):
                s = np.where(open_, np.where(np.isfinite(hi), (lo + hi) / 2, s * 2), s)
        w = weights(np.maximum(s, np.maximum(1e-3 * d.sum(axis=1) / size, 1e-300)))[there]
        i, j = np.repeat(f["key"].to_numpy(), size), np.concatenate(f["others"].tolist())
        yield pd.DataFrame({"i": np.concatenate([i, j]), "j": np.concatenate([j, i]), "w": np.concatenate([w, w])})


def neighbour_graph(rows: DataFrame, k: int, label: str | None = None, label_weight: float = 0.5) -> DataFrame:
    """(i, j, w) both ways round; rows: (key, features). With ``label`` edges between different labels are weakened, the more the nearer ``label_weight`` is to 1."""
    kind = rows.schema["key"].dataType.simpleString()
    near = nearest_rows(rows, rows, k, "key", "features").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "square"))).alias("n"))  # k a row
    edges = near.select("key", F.col("n.neighbour").alias("others"), F.col("n.square").alias("squares")).mapInPandas(_memberships, f"i {kind}, j {kind}, w double")
    both = edges.groupBy("i", "j").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("n"), F.min("w").alias("least"), F.max("w").alias("most"))
    united = both.select("i", "j", F.when(F.col("n") > 1, F.col("s") - F.col("least") * F.col("most")).otherwise(F.col("s")).alias("w"))
    if label is not None:
        far = 2.5 / (1 - label_weight) if label_weight < 1 else 1e12
        of = lambda side: rows.select(F.col("key").alias(side), F.col(label).alias(f"l{side}"))
        united = united.join(of("i"), "i").join(of("j"), "j").select("i", "j", (F.col("w") * F.when(F.col("li") == F.col("lj"), 1.0).otherwise(float(np.exp(-far)))).alias("w"))
    return united.filter("w > 1e-6")


def layout(rows: DataFrame, dims: int, k: int = 15, label: str | None = None, label_weight: float = 0.5, min_distance: float = 0.1, rounds: int = 40, rate: float = 0.6, seed: int = 0) -> DataFrame:
    """(key, place): rows (key, features[, label]) in ``dims`` dimensions. Keys are distinct."""
    a, b = curve(min_distance)
    numbered = stable(global_row_number(rows.select("key", "features", *([label] if label else [])), ["key"], "number"))
    n = numbered.count()
    graph = neighbour_graph(numbered.select(F.col("number").alias("key"), "features", *([label] if label else [])), k, label, label_weight)
    edges, _ = saved(graph)
    degree = edges.groupBy("i").agg(F.sum("w").alias("degree"))
    first = reduce_pooled(numbered.select(F.col("number").alias("row_id"), F.lit("train").alias("part"), F.lit(0).alias("target"), "features"), "svd", dims)
    widest = first.agg(F.max(F.array_max(F.transform("features", lambda x: F.abs(x))))).first()[0] or 1.0
    names = [f"y{c}" for c in range(dims)]
    start = first.select(F.col("row_id").alias("i"), *[(F.col("features")[c] * F.lit(10.0 / widest)).alias(names[c]) for c in range(dims)])
    places, path = saved(start.join(degree, "i", "left").select("i", F.coalesce("degree", F.lit(0.0)).alias("degree"), *names))
    cut = lambda x: F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), x))

    def forces(pairs: DataFrame, coefficient, weight: Column) -> DataFrame:
        square = sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in names), F.lit(0.0))
        return pairs.withColumn("d", square).select("i", *[(weight * cut(coefficient(F.col("d")) * (F.col(c) - F.col(f"o{c}")))).alias(f"f{c}") for c in names])

    pull = lambda d: F.when(d > 0, -2 * a * b * F.pow(d, F.lit(b - 1)) / (1 + a * F.pow(d, F.lit(b)))).otherwise(0.0)
    push = lambda d: 2 * b / ((0.001 + d) * (1 + a * F.pow(d, F.lit(b))))
    for turn in range(rounds):
        other = places.select(F.col("i").alias("j"), *[F.col(c).alias(f"o{c}") for c in names])
        held = edges.join(places.drop("degree"), "i").join(other, "j")
        partner = F.pmod(F.xxhash64("i", F.lit(turn), F.lit(seed), F.col("s")), F.lit(max(n, 1)))
        drawn = places.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(PARTNERS)))).withColumn("j", partner).filter("i <> j").join(other, "j")
        both = forces(held, pull, 2 * F.col("w")).unionByName(forces(drawn, push, F.col("degree") * REPULSION / PARTNERS))
        moved = both.groupBy("i").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in names])
        step = F.lit(rate * (1 - turn / rounds)) / F.greatest(F.col("degree"), F.lit(1.0))
        places, path = saved(places.join(moved, "i", "left").select("i", "degree", *[(F.col(c) + step * F.coalesce(f"f{c}", F.lit(0.0))).alias(c) for c in names]), path)
    return numbered.select("key", "number").join(places.withColumnRenamed("i", "number"), "number").select("key", F.array(*names).alias("place"))


def placed(new: DataFrame, rows: DataFrame, places: DataFrame, k: int = 15) -> DataFrame:
    """(key, place) of further rows: the mean of their nearest rows' places, weighted by nearness."""
    near = nearest_rows(new, rows, k, "key", "features").join(places.select(F.col("key").alias("neighbour"), "place"), "neighbour")
    weight = 1 / (1e-9 + F.col("square"))
    parts = near.select("key", weight.alias("w"), F.posexplode("place").alias("c", "y")).groupBy("key", "c").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))
    return parts.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "y"))), lambda p: p["y"]).alias("place"))  # an entry a dimension


def trustworthiness(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """How few of the k nearest in y are far in x: 1 at best (for rows at hand)."""
    n = len(x)
    rank = np.empty((n, n), int)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    np.put_along_axis(rank, np.argsort(d, axis=1, kind="stable"), np.arange(1, n + 1)[None, :].repeat(n, 0), axis=1)
    e = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(e, np.inf)
    near = np.argsort(e, axis=1, kind="stable")[:, :k]
    return float(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum())


# ---- autoencoder

Weights = dict[str, np.ndarray]


def encoded(w: Weights, x: np.ndarray) -> np.ndarray:
    return x @ w["V"] + np.tanh(x @ w["A"] + w["a"]) @ w["B"]


def decoded(w: Weights, z: np.ndarray) -> np.ndarray:
    return z @ w["V"].T + np.tanh(z @ w["B"].T + w["c"]) @ w["A"].T


def error_and_gradients(w: Weights, x: np.ndarray) -> tuple[float, Weights]:
    """Squared error of x against its decoded code, and its gradients, summed over the rows."""
    h = np.tanh(x @ w["A"] + w["a"])
    z = x @ w["V"] + h @ w["B"]
    g = np.tanh(z @ w["B"].T + w["c"])
    e = z @ w["V"].T + g @ w["A"].T - x
    dg = (e @ w["A"]) * (1 - g * g)
    dz = e @ w["V"] + dg @ w["B"]
    dh = (dz @ w["B"].T) * (1 - h * h)
    return float((e * e).sum()), {"V": 2 * (e.T @ z + x.T @ dz), "A": 2 * (e.T @ g + x.T @ dh), "a": 2 * dh.sum(axis=0), "B": 2 * (dg.T @ z + h.T @ dz), "c": 2 * dg.sum(axis=0)}


def _errors(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    w, mean, scale = shared.value
    n, error, total = 0, 0.0, None
    for f in frames:
        if len(f):
            more, g = error_and_gradients(w, (matrix(f["features"]) - mean) / scale)
            flat = np.concatenate([g[c].ravel() for c in w])
            n, error, total = n + len(f), error + more, flat if total is None else total + flat
    if n:
        yield pd.DataFrame({"n": [n], "error": [error], "gradient": [total]})


def _encoded_rows(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    w, mean, scale = shared.value
    for f in frames:
        yield f.assign(features=list(encoded(w, (matrix(f["features"]) - mean) / scale))) if len(f) else f


def autoencoder(rows: DataFrame, k: int, hidden: int = 32, rounds: int = 40, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """(rows with codes of k numbers as features, mean squared error of each evaluation, the first that of the principal components).

    rows: (part, features, ...), fitted on part ``train``. A round is one job that sends a sum of gradients a task to the driver.
    """
    rows = rows.withColumn("features", F.col("features").cast("array<double>"))
    context, train = rows.sparkSession.sparkContext, stable(rows.filter("part = 'train'").select("features"))
    n, total, gram = gram_sums(train, _same)
    mean = total / n
    moments = gram - n * np.outer(mean, mean)
    scale = float(np.sqrt(max(np.trace(moments), 1e-300) / (n * len(mean))))  # one number, so that errors stay those of the rows
    _, v = np.linalg.eigh(moments)
    rng, d = np.random.default_rng(seed), len(mean)
    w: Weights = {"V": la.padded(la.sign_fixed(v[:, ::-1]), k), "A": 0.5 * rng.normal(size=(d, hidden)) / d**0.5, "a": np.zeros(hidden), "B": np.zeros((hidden, k)), "c": np.zeros(hidden)}
    best, errors = (np.inf, w), []

    def f(flat: np.ndarray) -> tuple[float, np.ndarray]:
        nonlocal best
        own, at = {}, 0
        for c, like in w.items():
            own[c] = flat[at : at + like.size].reshape(like.shape)
            at += like.size
        shared = context.broadcast((own, mean, scale))
        found = train.coalesce(MAX_TASKS).mapInPandas(partial(_errors, shared=shared), "n long, error double, gradient array<double>").toPandas()  # a row a task
        shared.unpersist()
        errors.append(float(found["error"].sum()) * scale**2 / n)
        if errors[-1] < best[0]:
            best = errors[-1], own
        return float(found["error"].sum()) / n, np.sum(found["gradient"].to_list(), axis=0) / n

    f(np.concatenate([x.ravel() for x in w.values()]))
    # the components are a point without slope: the search sets out a little beside them
    beside = {**w, "B": 0.2 * rng.normal(size=(hidden, k)), "c": 0.5 * rng.normal(size=hidden)}
    lbfgs(f, np.concatenate([beside[c].ravel() for c in w]), rounds)
    return rows.mapInPandas(partial(_encoded_rows, shared=context.broadcast((best[1], mean, scale))), rows.schema), errors


def _same(x: np.ndarray) -> np.ndarray:
    return x
