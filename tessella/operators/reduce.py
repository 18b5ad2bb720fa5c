"""Local reductions: each institution fits a map on its own training rows and applies it to its rows and to the anchors.

A group is one institution's rows, whose number the split fixes. Only ``features`` of that group and the anchors are seen. The centralised
baseline, which sees the rows of all, has a form of its own (``reduce_pooled``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as la
from .pairs import MAX_REFERENCE, bounded_draw

#: (train rows, train labels, dimensions, institution, seed, gamma ratio) -> (map, gamma or nan)
Fit = Callable[[np.ndarray, np.ndarray, int, int, int, float], tuple[la.Transform, float]]
SCHEMA = "institution int, part string, row_id long, target int, features array<double>, gamma double"
#: Methods whose map over the pooled rows of all institutions comes from sums, and the landmarks that span their kernels.
POOLED, LANDMARKS = ("svd", "kernel_pca", "kernel_pca_self_tuning", "cca", "samespan", "samespan_orth"), 500
#: Tasks that add up a Gram matrix each.
MAX_TASKS = 256
#: Institutions cycle through so many kernel widths under ``kernel_pca_unfixed_gamma``.
WIDTH_CYCLE = 6


def _svd(x, y, k, inst, seed, ratio):
    mean, v = la.pca(x, k)
    return (lambda z: (z - mean) @ v), np.nan


def _diffspan(x, y, k, inst, seed, ratio):
    base, _ = _svd(x, y, k, inst, seed, ratio)
    e = np.random.default_rng([seed, inst]).uniform(-1, 1, (k, k))
    return (lambda z: base(z) @ e), np.nan


def _samespan_orth(x, y, k, inst, seed, ratio):
    shared = la.random_orthogonal(x.shape[1], np.random.default_rng([seed, 0]))[:, :k]
    e = la.random_orthogonal(shared.shape[1], np.random.default_rng([seed, 1, inst]))
    return (lambda z: la.padded(z @ shared @ e, k)), np.nan


def _samespan(x, y, k, inst, seed, ratio):
    shared = np.random.default_rng([seed, 0]).normal(size=(x.shape[1], k))
    e = np.random.default_rng([seed, 1, inst]).uniform(-1, 1, (k, k))
    return (lambda z: z @ shared @ e), np.nan


def _lpp(x, y, k, inst, seed, ratio):
    v = la.locality_projection(x, k, max(1, len(x) // 5))
    return (lambda z: z @ v), np.nan


def _kcca(x, y, k, inst, seed, ratio):
    gamma = 1 / x.shape[1]
    return la.kernel_cca(x, _one_hot(y), k, gamma), gamma


def _one_hot(y: np.ndarray) -> np.ndarray:
    return (y[:, None] == np.unique(y)).astype(float)


def _cca(x, y, k, inst, seed, ratio):
    mean, (_, v) = x.mean(axis=0), la.cca(x, _one_hot(y), k)
    return (lambda z: (z - mean) @ v), np.nan


def _kcca_whitened(x, y, k, inst, seed, ratio):
    gamma = la.median_width(x) * ratio
    return la.whitened_kernel_cca(x, _one_hot(y), k, gamma)[1], gamma


def _kcca_symmetric(x, y, k, inst, seed, ratio):
    gamma = la.median_width(x) * ratio
    return la.symmetric_kernel_cca(x, _one_hot(y), k, gamma), gamma


def _kernel_pca(x, y, k, inst, seed, ratio, rule="auto"):
    mean, s = x.mean(axis=0), x.std(axis=0)
    scale = lambda z: (z - mean) / np.where(s == 0, 1, s)
    gamma = 1 / x.shape[1]
    if rule == "self_tuning":
        gamma = la.self_tuning(x) * ratio
    elif rule == "unfixed" and inst % WIDTH_CYCLE:
        gamma = la.self_tuning(x) * 10.0 ** (inst % WIDTH_CYCLE - 3)
    elif rule == "random":
        gamma = (0.1, 1.0, 5.0)[seed % 3]
    inner = la.kernel_pca(scale(x), k, gamma)
    return (lambda z: inner(scale(z))), gamma


def _mixed(x, y, k, inst, seed, ratio):
    return _svd(x, y, k, inst, seed, ratio) if inst % 2 else _kernel_pca(x, y, k, inst, seed, ratio, "self_tuning")


def _unfixed_mixed(x, y, k, inst, seed, ratio):
    return _kernel_pca(x, y, k, inst, seed, ratio, "unfixed") if inst % WIDTH_CYCLE else _svd(x, y, k, inst, seed, ratio)


METHODS: dict[str, Fit] = {
    "svd": _svd, "diffspan": _diffspan, "samespan_orth": _samespan_orth, "samespan": _samespan, "lpp": _lpp, "kcca": _kcca,
    "cca": _cca, "kcca_whitened": _kcca_whitened, "kcca_symmetric": _kcca_symmetric,
    "kernel_pca": _kernel_pca, "kernel_pca_self_tuning": partial(_kernel_pca, rule="self_tuning"), "kernel_pca_unfixed_gamma": partial(_kernel_pca, rule="unfixed"),
    "kernel_pca_random_gamma": partial(_kernel_pca, rule="random"), "kernel_pca_svd_mixed": _mixed, "kernel_pca_unfixed_mixed": _unfixed_mixed}


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _local(rows: pd.DataFrame, anchors, fit: Fit, k: int, seed: int, ratio: float) -> pd.DataFrame:
    inst = int(rows["institution"].iloc[0])
    rows = rows.sort_values(["split", "row_id"], kind="stable")
    train = rows[rows["split"] == "train"]
    transform, gamma = fit(matrix(train["features"]), train["target"].to_numpy(), k, inst, seed, ratio)
    out = [rows.assign(part=rows["split"], features=list(transform(matrix(rows["features"]))))[["part", "row_id", "target", "features"]]]
    for name, (ids, x) in anchors.value.items():
        out.append(pd.DataFrame({"part": name, "row_id": ids, "target": -1, "features": list(transform(x))}))
    return pd.concat(out).assign(institution=inst, gamma=gamma)[["institution", "part", "row_id", "target", "features", "gamma"]]


def anchor_matrices(anchors: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The anchors on the driver: a reference set of checked size."""
    found = anchors.limit(2 * MAX_REFERENCE + 1).toPandas()
    if len(found) > 2 * MAX_REFERENCE:
        raise ValueError(f"at most {MAX_REFERENCE} anchors a set")
    found = found.sort_values(["anchor_set", "anchor_id"])
    return {name: (g["anchor_id"].to_numpy(), matrix(g["features"])) for name, g in found.groupby("anchor_set")}


def reduce_locally(rows: DataFrame, anchors: DataFrame, method: str, k: int, seed: int = 0, gamma_ratio: float = 1.0) -> DataFrame:
    """rows: (row_id, institution, split, target, features). Result: images of all rows and of both anchor sets, as parts
    ``train``, ``test``, ``anchor`` and ``anchor_test`` of one long table."""
    if method not in METHODS:
        raise ValueError(f"unknown reduction {method!r}: one of {sorted(METHODS)}")
    shared = rows.sparkSession.sparkContext.broadcast(anchor_matrices(anchors))
    own = rows.select(F.col("institution").cast("int").alias("institution"), "split", F.col("row_id").cast("long").alias("row_id"), F.col("target").cast("int").alias("target"), F.col("features").cast("array<double>").alias("features"))
    return own.groupBy("institution").applyInPandas(partial(_local, anchors=shared, fit=METHODS[method], k=k, seed=seed, ratio=gamma_ratio), SCHEMA)


IDENTITIES = "institution int, n_train long, n_test long, n_anchor long, rank int, centred boolean, orthogonal boolean, affine boolean"


def _identities(rows: pd.DataFrame, anchors) -> pd.DataFrame:
    part = {name: rows[rows["part"] == name].sort_values("row_id") for name in ("train", "test", "anchor")}
    train, image = matrix(part["train"]["features"]), matrix(part["anchor"]["features"])
    size = np.linalg.norm(train, axis=0)
    unit = train / np.where(size > 1e-12 * max(size.max(initial=0), 1e-300), size, np.inf)
    gram = unit.T @ unit
    given = np.hstack([anchors.value, np.ones((len(anchors.value), 1))])
    rest = image - given @ np.linalg.lstsq(given, image, rcond=None)[0]
    told = {"institution": int(rows["institution"].iloc[0]), **{f"n_{n}": len(p) for n, p in part.items()}, "rank": int(np.linalg.matrix_rank(train, tol=1e-6 * max(np.linalg.norm(train, 2), 1e-300))),
            "centred": bool(np.abs(unit.mean(axis=0)).max(initial=0) < 1e-6), "orthogonal": bool(np.abs(gram - np.diag(np.diag(gram))).max(initial=0) < 1e-4), "affine": bool(np.linalg.norm(rest) < 1e-6 * max(np.linalg.norm(image - image.mean(axis=0)), 1e-300))}
    return pd.DataFrame([told]).astype({"institution": "int32", "rank": "int32"})


def identities(reduced: DataFrame, anchors: DataFrame) -> DataFrame:
    """What a reduction keeps, a row an institution: rows by part, rank of the training images, whether their columns have mean zero and are orthogonal, and whether
    the anchors' images are an affine function of the anchors (more anchors than features are needed to tell). What is left of an affine fit is held against
    the images' spread: a constant part, which far from the rows is nearly all of a kernel's images, tells nothing."""
    shared = reduced.sparkSession.sparkContext.broadcast(anchor_matrices(anchors)["anchor"][1])
    return reduced.groupBy("institution").applyInPandas(partial(_identities, anchors=shared), IDENTITIES)


@dataclass(frozen=True)
class _Lift:
    """Rows to the space whose principal components are wanted: standardised, and by kernel values with landmarks if there are any."""

    shift: np.ndarray
    scale: np.ndarray
    landmarks: np.ndarray | None = None
    half: np.ndarray | None = None
    gamma: float = np.nan

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        return z if self.landmarks is None else la.rbf(z, self.landmarks, self.gamma) @ self.half


def _moments(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    """One task's count and sum (row -1) and the rows of its Gram matrix."""
    n, total, gram = 0, 0.0, 0.0
    for f in frames:
        if len(f):
            z = shared.value(matrix(f["features"]))
            n, total, gram = n + len(z), total + z.sum(axis=0), gram + z.T @ z
    if n:
        yield pd.DataFrame({"i": np.arange(-1, len(gram)), "n": n, "v": [total, *gram]})


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": rows["i"].iloc[:1], "n": [int(rows["n"].sum())], "v": [np.sum(rows["v"].tolist(), axis=0)]})


def _pooled(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    lift, mean, v = shared.value
    for f in frames:
        yield f.assign(features=list((lift(matrix(f["features"])) - mean) @ v)) if len(f) else f


def gram_sums(rows: DataFrame, lift: Callable[[np.ndarray], np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, Gram matrix) of lifted ``features``: tasks add up their rows, Spark the tasks' sums."""
    sums = rows.select("features").coalesce(MAX_TASKS).mapInPandas(partial(_moments, shared=rows.sparkSession.sparkContext.broadcast(lift)), "i int, n long, v array<double>")
    found = sums.groupBy("i").applyInPandas(_added, "i int, n long, v array<double>").toPandas().sort_values("i")  # a row a dimension
    if not len(found):
        raise ValueError("no rows")
    return int(found["n"].iloc[0]), np.array(found["v"].iloc[0]), matrix(found["v"].iloc[1:])


def _plain(x: np.ndarray) -> np.ndarray:
    return x


def top_singular_value(rows: DataFrame) -> float:
    """Leading singular value of all ``features``, from their Gram matrix."""
    return float(la.top_singular(gram_sums(rows, _plain)[2], 2000, 1e-12)[0] ** 0.5)


def _inverted(rows: pd.DataFrame, anchors) -> pd.DataFrame:
    """What one institution's private images give away: the linear map learned from its anchors, applied backwards to its test rows."""
    image = rows[rows["part"] == "anchor"].sort_values("row_id")
    test = rows[rows["part"] == "test"]
    guess = la.linear_inversion(matrix(image["features"]), anchors.value, matrix(test["features"])) if len(test) else []
    return test[["institution", "row_id"]].assign(guess=list(guess))


def inverted(reduced: DataFrame, anchors: DataFrame) -> DataFrame:
    """(institution, row_id, guess): the test rows as an attacker who knows the anchors would rebuild them. Each institution's inverse is made beside its rows."""
    shared = reduced.sparkSession.sparkContext.broadcast(anchor_matrices(anchors)["anchor"][1])
    return reduced.groupBy("institution").applyInPandas(partial(_inverted, anchors=shared), "institution int, row_id long, guess array<double>")


def _reduced_by(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(features=list(shared.value(matrix(f["features"])))) if len(f) else f


@dataclass(frozen=True)
class _Straight:
    """Rows less a centre, through a matrix."""

    centre: np.ndarray
    through: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.through


def _straight_pooled(rows: DataFrame, train: DataFrame, method: str, k: int, seed: int) -> DataFrame:
    """The methods whose map is one matrix: random ones, and canonical directions from the moments of rows and labels side by side."""
    width = train.select("features").first()
    if width is None:
        raise ValueError("no training rows")
    d = len(width[0])
    if method == "cca":
        classes = [r[0] for r in train.select("target").distinct().orderBy("target").collect()]  # the labels
        both = train.select(F.concat("features", F.array(*[(F.col("target") == c).cast("double") for c in classes])).alias("features"))
        n, total, gram = gram_sums(both, _plain)
        moments = gram - np.outer(total, total) / n
        found = _Straight(total[:d] / n, la.cca_of_moments(moments[:d, :d], moments[:d, d:], moments[d:, d:], k)[1])
    elif method == "samespan_orth":
        shared = la.random_orthogonal(d, np.random.default_rng([seed, 0]))[:, :k]
        found = _Straight(np.zeros(d), la.padded(shared @ la.random_orthogonal(shared.shape[1], np.random.default_rng([seed, 1, 0])), k))
    else:
        found = _Straight(np.zeros(d), np.random.default_rng([seed, 0]).normal(size=(d, k)) @ np.random.default_rng([seed, 1, 0]).uniform(-1, 1, (k, k)))
    return rows.mapInPandas(partial(_reduced_by, shared=rows.sparkSession.sparkContext.broadcast(found)), rows.schema)


def reduce_pooled(rows: DataFrame, method: str, k: int, ratio: float = 1.0, landmarks: int = LANDMARKS) -> DataFrame:
    """One map for the rows of all institutions, fitted on their training rows: (row_id, part, features, ...) with reduced features.

    Nothing is pooled in a task. The components come from a Gram matrix that tasks add up: of the features, or, for a kernel, of the rows'
    kernel values with a bounded draw of training rows. With as many landmarks as training rows that is kernel PCA itself, with fewer
    it is its approximation in the span of the landmarks.
    """
    if method not in POOLED:
        raise ValueError(f"no pooled form of {method!r}: one of {POOLED}")
    context = rows.sparkSession.sparkContext
    rows = rows.withColumn("features", F.col("features").cast("array<double>"))
    train = rows.filter(F.col("part") == "train").select("row_id", "features")
    if method in ("cca", "samespan", "samespan_orth"):
        return _straight_pooled(rows, rows.filter(F.col("part") == "train"), method, k, 0)
    stats = train.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()  # a row a dimension
    if not stats:
        raise ValueError("no training rows")
    mean, deviation = np.array([r["m"] for r in stats]), np.array([r["s"] or 1.0 for r in stats])
    if method == "svd":
        lift = _Lift(mean, np.ones(len(mean)))
    else:
        some = matrix(bounded_draw(train, "row_id", landmarks).toPandas()["features"])
        gamma = 1 / len(mean) if method == "kernel_pca" else la.self_tuning(some) * ratio
        points = (some - mean) / deviation
        lift = _Lift(mean, deviation, points, la.inverse_root(la.rbf(points, points, gamma)), gamma)
    n, total, gram = gram_sums(train, lift)
    centre = total / n
    _, v = np.linalg.eigh(gram - n * np.outer(centre, centre))
    shared = context.broadcast((lift, centre, la.padded(la.sign_fixed(v[:, ::-1]), k)))
    return rows.mapInPandas(partial(_pooled, shared=shared), rows.schema)
