"""Integration: one solve on the anchors' images gives each institution its map into the shared space.

Every method but one looks for a few directions in the space of the r anchors that all institutions can reach: leading or least eigenvectors of a sum over
institutions of r x r matrices. Tasks make their institutions' terms and add them up, Spark adds the tasks' sums, and the driver solves an
r x r eigenproblem, however many institutions there are. What travels back is the target (r x p); an institution's map is made from it, beside its rows,
from the institution's own anchor image. The driver never sees an image, let alone a row.

Terms: S S' (Imakura), the projection on the columns of S (targetvec, QR_SVD), S (S'S + ridge I)^-1 S' (GEP: with C = S (S'S + ridge I)^-1/2 side by side, its
pairs are those of C'C), and (H - I)'(H - I) for a smoother H of the image (nonlinear). ODC needs only the first institution's image. GEP with a shift
or plain-orthonormal columns is no such sum, and is solved whole on the driver within bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as la
from ..session import stable
from . import selection as sel
from .reduce import SCHEMA, matrix

#: Anchors of a solve; tasks that add up terms, each sending one sum of r x r.
MAX_SIDE, MAX_TASKS = 5000, 64
RIDGE = 1e-6
METHODS = ("Imakura", "targetvec", "QR_SVD", "GEP", "GEP_weighted", "GEP_weighted_maps", "ODC", "nonlinear", "nonlinear_linear", "nonlinear_tuning")
NONLINEAR = ("nonlinear", "nonlinear_linear", "nonlinear_tuning")
SELECTING = ("targetvec", *NONLINEAR)


@dataclass(frozen=True)
class Method:
    """A method and what it is run with."""

    name: str
    penalty: float = 0.1
    width: str = "auto"
    width_ratio: float = 1.0

    def __post_init__(self) -> None:
        if self.name not in METHODS:
            raise ValueError(f"unknown integration {self.name!r}")
        if self.name == "nonlinear_tuning":
            object.__setattr__(self, "penalty", 1e-9)

    def gamma(self, image: np.ndarray, local: float) -> float:
        if self.width == "same_as_f":
            return local if np.isfinite(local) else 1 / image.shape[1]
        if self.width == "X_tuning":
            return la.self_tuning(image, 3) * self.width_ratio
        if self.width == "auto":
            return 1 / image.shape[1]
        raise ValueError(f"kernel width must be auto, X_tuning or same_as_f, not {self.width!r}")

    def smoother(self, image: np.ndarray, gamma: float):
        return la.smoother(image, gamma, self.penalty, self.name == "nonlinear_linear")

    def term(self, image: np.ndarray, gamma: float) -> np.ndarray:
        """What one institution adds to the sum."""
        if self.name == "Imakura":
            return image @ image.T
        if self.name in ("targetvec", "QR_SVD"):
            u, s, _ = np.linalg.svd(image, full_matrices=False)
            u = u[:, s > s.max(initial=0) * 1e-10]
            return u @ u.T
        if self.name in NONLINEAR:
            rest = self.smoother(image, gamma)[0] - np.eye(len(image))
            return rest.T @ rest
        return image @ np.linalg.solve(image.T @ image + RIDGE * np.eye(image.shape[1]), image.T)

    def solved(self, total: np.ndarray, m: int, p: int, anchor_target: np.ndarray | None, rule: str, ratio: float) -> Solution:
        """The target from the sum of m terms; zero columns beyond its rank."""
        keep = p if anchor_target is None else len(total)
        if self.name in NONLINEAR:
            values, target = la.smallest(total / max(np.trace(total), 1e-300), keep)
            scale = np.ones(len(values))
        else:
            w, v = np.linalg.eigh((total + total.T) / 2)
            w, v = w[::-1][:keep], v[:, ::-1][:, :keep]
            good = w > max(w[0], 0) * 1e-12
            w, target = w[good], la.sign_fixed(v[:, good])
            values = m - w if self.name == "targetvec" else None if self.name == "Imakura" else 2 * m - 2 * w
            scale = np.sqrt(w) if self.name.startswith("GEP") or self.name == "QR_SVD" else np.ones(len(w))
        if anchor_target is not None:
            chosen = sel.choose(target, anchor_target, p, rule, ratio)
            values, target, scale = values[chosen], target[:, chosen], scale[chosen]
        weights = np.resize(la.eigen_weights(values), len(values)) if self.name == "GEP_weighted_maps" else np.ones(len(scale))
        return Solution(self, la.padded(target, p), values, la.padded(target * (weights / scale), p))


@dataclass
class Solution:
    """The target, and from it the map of any institution; ``linear`` where maps were found otherwise."""

    method: Method
    target: np.ndarray | None = None
    values: np.ndarray | None = None
    goal: np.ndarray | None = None
    reference: np.ndarray | None = None
    gammas: dict[int, float] = field(default_factory=dict)
    linear: dict[int, np.ndarray] = field(default_factory=dict)

    def map_of(self, institution: int, image: np.ndarray | None, local: float = np.nan) -> np.ndarray | la.Transform:
        """A matrix for linear methods, else a function."""
        if institution in self.linear:
            return self.linear[institution]
        name = self.method.name
        if name == "ODC":
            if image.shape[1] != self.reference.shape[1]:
                raise ValueError("ODC needs images of one width")
            return la.procrustes(image, self.reference)
        if name in NONLINEAR:
            gamma = self.gammas.get(institution) or self.method.gamma(image, local)
            return self.method.smoother(image, gamma)[1](self.target)
        if name.startswith("GEP"):
            return np.linalg.solve(image.T @ image + RIDGE * np.eye(image.shape[1]), image.T @ self.goal)
        return np.linalg.pinv(image, rcond=1e-10) @ self.goal

    def transform(self, institution: int, image: np.ndarray | None = None, local: float = np.nan) -> la.Transform:
        found = self.map_of(institution, image, local)
        return (lambda x: x @ found) if isinstance(found, np.ndarray) else found


def images_of(reduced: DataFrame, part: str = "anchor", columns: int | None = 4 * MAX_SIDE) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Anchor images by institution, rows in anchor order, and the local kernel widths. ``columns`` in all at most; None where no matrix of that side is formed."""
    anchors = reduced.filter(F.col("part") == part).select("institution", "row_id", "features", "gamma")
    rows, wide = anchors.agg(F.max("row_id"), F.max(F.size("features"))).first()
    n = anchors.select("institution").distinct().count()
    if rows is not None and (rows >= MAX_SIDE or columns is not None and n * wide > columns):
        raise ValueError(f"at most {MAX_SIDE} anchors and {columns} columns in all")
    found = anchors.toPandas().sort_values(["institution", "row_id"])
    return {int(i): matrix(g["features"]) for i, g in found.groupby("institution")}, {int(i): float(g["gamma"].iloc[0]) for i, g in found.groupby("institution")}


def _institutions(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, float]]:
    """(institution, image, local width) from anchor rows sorted by institution and anchor, whatever the batches."""
    held: list[pd.DataFrame] = []

    def whole():
        rows = pd.concat(held)
        return int(rows["institution"].iloc[0]), matrix(rows["features"]), float(rows["gamma"].iloc[0])

    for f in frames:
        for i, rows in f.groupby("institution", sort=True):
            if held and held[0]["institution"].iloc[0] != i:
                yield whole()
                held = []
            held.append(rows)
    if held:
        yield whole()


def anchor_rows(reduced: DataFrame) -> tuple[DataFrame, int, int]:
    """(anchor rows dealt to tasks, institutions, anchors)."""
    anchors = reduced.filter(F.col("part") == "anchor").select("institution", "row_id", "features", "gamma")
    r, m = anchors.agg(F.max("row_id"), F.count_if(F.col("row_id") == 0)).first()
    if r is None:
        raise ValueError("no anchors")
    if r >= MAX_SIDE:
        raise ValueError(f"at most {MAX_SIDE} anchors")
    n = max(1, min(MAX_TASKS, m, reduced.sparkSession.sparkContext.defaultParallelism))
    return anchors.repartition(n, "institution").sortWithinPartitions("institution", "row_id"), m, r + 1


SUMS = "i int, v array<double>"


def _task_sum(frames: Iterator[pd.DataFrame], term: Callable[[int, np.ndarray, float], np.ndarray]) -> Iterator[pd.DataFrame]:
    total = None
    for i, image, local in _institutions(frames):
        more = term(i, image, local)
        total = more if total is None else total + more
    if total is not None:
        yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "v": list(total)})


def _row_sum(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": rows["i"].iloc[:1], "v": [np.sum(rows["v"].tolist(), axis=0)]})


def summed(anchors: DataFrame, term: Callable[[int, np.ndarray, float], np.ndarray]) -> np.ndarray:
    """Sum over institutions of a matrix of each: within tasks, then row by row between them."""
    sums = anchors.mapInPandas(partial(_task_sum, term=term), SUMS).groupBy("i").applyInPandas(_row_sum, SUMS)
    return matrix(sums.toPandas().sort_values("i")["v"])  # as many rows as anchors, or three times half of them


def _term(i: int, image: np.ndarray, local: float, method: Method, gammas: dict[int, float]) -> np.ndarray:
    return method.term(image, (gammas.get(i) or method.gamma(image, local)) if method.name in NONLINEAR else np.nan)


def _coordinates(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    for i, image, _ in _institutions(frames):
        yield pd.DataFrame({"institution": [i], "image": [(shared.value.T @ image).ravel()]})


def coordinates_of(reduced: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """(anchor images by institution, anchors): each image in coordinates of the directions of the anchors' space that all images reach together.

    Inner products of columns, of one image or of two, are those of the images themselves; there are as many rows as directions, for linear reductions
    one more than features at most, however many anchors there are. The directions come from the sum of GEP's terms; one whose share of the sum
    is below its rounding is left out.
    """
    anchors, _, r = anchor_rows(reduced)
    w, v = np.linalg.eigh(summed(anchors, partial(_term, method=Method("GEP"), gammas={})))
    v = v[:, (w > max(w[-1], 0) * r * np.finfo(float).eps) | (np.arange(r) == r - 1)]  # one at least, for images of nothing
    shared = reduced.sparkSession.sparkContext.broadcast(v)
    found = anchors.mapInPandas(partial(_coordinates, shared=shared), "institution int, image array<double>").toPandas()  # a row an institution
    return {int(i): np.reshape(image, (v.shape[1], -1)) for i, image in sorted(zip(found["institution"], found["image"], strict=True), key=lambda x: x[0])}, r


# ---- search of the kernel widths

class Tuning:
    """What the loss of a choice of widths needs, as sums over institutions: of (H - I)'(H - I) and of R'R and R, where H smooths the first half of the
    anchors and R tells the second half from it. Moving one institution changes its own terms alone, so a round costs in proportion to their number."""

    def __init__(self, p: int, penalty: float, sums: np.ndarray, m: int) -> None:
        self.p, self.penalty, self.sums, self.m = p, penalty, sums, m

    @staticmethod
    def terms(image: np.ndarray, gamma: float, penalty: float) -> np.ndarray:
        """The three matrices under each other; the last is as long as the second half."""
        half = len(image) // 2
        hat, fitted = la.smoother(image[:half], gamma, penalty)
        rest, ahead = hat - np.eye(half), fitted(np.eye(half))(image[half:])
        return np.vstack([rest.T @ rest, ahead.T @ ahead, ahead])

    def loss(self, change: np.ndarray | float = 0.0) -> float:
        sums, half = self.sums + change, self.sums.shape[1]
        fit, square, ahead = sums[:half], sums[half : 2 * half], sums[2 * half :]
        _, z = la.smallest(fit / max(np.trace(fit), 1e-300), self.p)
        mean = ahead @ z / self.m
        size = float((mean**2).sum())
        return max(float((z * (square @ z)).sum()) - self.m * size, 0.0) / max(size, 1e-300)

    def change(self, image: np.ndarray, old: float, new: float) -> np.ndarray:
        return self.terms(image, float(np.exp(new)), self.penalty) - self.terms(image, float(np.exp(old)), self.penalty)

    def slope(self, image: np.ndarray, at: float) -> float:
        return self.loss(self.change(image, at, at + 1e-4)) - self.loss(self.change(image, at, at - 1e-4))


def _search(tuning: Tuning, logs: dict[int, float], slopes_of: Callable[[Tuning, dict[int, float]], dict[int, float]], images_of_: Callable[[set[int]], Iterator[tuple[int, np.ndarray]]], rounds: int) -> dict[int, float]:
    """A round takes the slopes of all open widths at once and then moves each in turn, downhill by tenfold at first, or uphill where only that helps.
    A width that neither helps halves its step; with two halvings, or no slope, it is settled. Every open width comes back in the next round."""
    step, left, best = dict.fromkeys(logs, np.log(10.0)), dict.fromkeys(sorted(logs), 2), tuning.loss()
    for _ in range(rounds):
        slopes = slopes_of(tuning, {i: logs[i] for i in left})
        for i in [i for i in left if not slopes[i]]:
            del left[i]
        for i, image in images_of_(set(left)):
            for side in (-np.sign(slopes[i]), np.sign(slopes[i])):
                change = tuning.change(image, logs[i], logs[i] + side * step[i])
                if (new := tuning.loss(change)) < best:
                    logs[i], best, tuning.sums = logs[i] + side * step[i], new, tuning.sums + change
                    break
            else:
                step[i] /= 2
                left[i] -= 1
                if not left[i]:
                    del left[i]
        if not left:
            break
    return {i: float(np.exp(v)) for i, v in logs.items()}


def tuned_widths(images: dict[int, np.ndarray], p: int, start: dict[int, float], penalty: float = 1e-9, rounds: int = 300) -> dict[int, float]:
    """Search on the log widths for the least disagreement on the second half of the anchors, for images at hand."""
    tuning = Tuning(p, penalty, sum(Tuning.terms(s, start[i], penalty) for i, s in images.items()), len(images))
    slopes = lambda t, logs: {i: t.slope(images[i], at) for i, at in logs.items()}
    return _search(tuning, {i: float(np.log(g)) for i, g in start.items()}, slopes, lambda ids: ((i, images[i]) for i in sorted(ids)), rounds)


def _started(frames: Iterator[pd.DataFrame], method: Method) -> Iterator[pd.DataFrame]:
    for i, image, local in _institutions(frames):
        yield pd.DataFrame({"institution": [i], "gamma": [method.gamma(image, local)]})


def _first_terms(i: int, image: np.ndarray, local: float, gammas: dict[int, float], penalty: float) -> np.ndarray:
    return Tuning.terms(image, gammas[i], penalty)


def _slopes(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    tuning, logs = shared.value
    for i, image, _ in _institutions(frames):
        if i in logs:
            yield pd.DataFrame({"institution": [i], "slope": [tuning.slope(image, logs[i])]})


def open_images(anchors: DataFrame, ids: set[int]) -> DataFrame:
    """(institution, n, image): the images of ``ids`` alone, in their order, n anchors' numbers one after another."""
    held = anchors.filter(F.col("institution").isin(sorted(ids))).groupBy("institution").agg(F.array_sort(F.collect_list(F.struct("row_id", "features"))).alias("rows"))
    return held.select("institution", F.size("rows").alias("n"), F.flatten("rows.features").alias("image")).orderBy("institution")


def tuned_widths_of(anchors: DataFrame, method: Method, p: int, m: int, rounds: int = 300) -> dict[int, float]:
    """The same search for anchor images that lie with Spark: tasks take the slopes; the moves, which depend on each other, see one image at a time.

    The driver holds a number for each institution and three matrices of half the anchors' side.
    """
    context, anchors = anchors.sparkSession.sparkContext, stable(anchors)
    start = {int(i): float(g) for i, g in anchors.mapInPandas(partial(_started, method=method), "institution int, gamma double").toPandas().itertuples(index=False)}
    tuning = Tuning(p, method.penalty, summed(anchors, partial(_first_terms, gammas=start, penalty=method.penalty)), m)

    def slopes(t: Tuning, logs: dict[int, float]) -> dict[int, float]:
        shared = context.broadcast((t, logs))
        found = anchors.mapInPandas(partial(_slopes, shared=shared), "institution int, slope double").toPandas()  # a number an institution
        shared.unpersist()
        return dict(zip(found["institution"].astype(int), found["slope"], strict=True))

    def images(ids: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        if not ids:
            return
        for row in open_images(anchors, ids).toLocalIterator():
            yield int(row["institution"]), np.array(row["image"], float).reshape(row["n"], -1)

    return _search(tuning, {i: float(np.log(g)) for i, g in start.items()}, slopes, images, rounds)


# ---- solving and mapping

def solve(images: dict[int, np.ndarray], p: int, method: str, penalty: float = 0.1, width: str = "auto", width_ratio: float = 1.0, local_widths: dict[int, float] | None = None, shift: float = 0.0, orthonormal: bool = False, anchor_target: np.ndarray | None = None, selection: str = "forward", selection_ratio: float = 0.5) -> Solution:
    """The solution for images at hand, with every linear map. With ``anchor_target``, the anchors' labels in their order, ``targetvec`` and the nonlinear
    methods take a share ``selection_ratio`` of their directions by what they tell of the labels."""
    how, order, local = Method(method, penalty, width, width_ratio), sorted(images), local_widths or {}
    if anchor_target is not None and method not in SELECTING:
        raise ValueError(f"only {SELECTING} take a selection by labels")
    if method.startswith("GEP") and (shift or orthonormal):
        values, found = la.block_eigen([images[i] for i in order], p, RIDGE, shift, orthonormal)
        weights = np.resize(la.eigen_weights(values), p) if method == "GEP_weighted_maps" else 1.0  # in the maps themselves, so that rows come out weighted
        return Solution(how, values=values, linear={i: g * weights for i, g in zip(order, found, strict=True)})
    if method == "ODC":
        solution = Solution(how, reference=images[order[0]])
    else:
        gammas = {}
        if method in NONLINEAR:
            gammas = {i: how.gamma(images[i], local.get(i, np.nan)) for i in order}
            if method == "nonlinear_tuning":
                gammas = tuned_widths(images, p, gammas, how.penalty)
        solution = how.solved(sum(_term(i, images[i], np.nan, how, gammas) for i in order), len(order), p, anchor_target, selection, selection_ratio)
        solution.gammas = gammas
    if method not in NONLINEAR:
        solution.linear = {i: solution.map_of(i, images[i]) for i in order}
    return solution


def _projected(rows: pd.DataFrame, shared) -> pd.DataFrame:
    anchors = rows[rows["part"] == "anchor"].sort_values("row_id")
    transform = shared.value.transform(int(rows["institution"].iloc[0]), matrix(anchors["features"]), float(rows["gamma"].iloc[0]))
    return rows.assign(features=list(transform(matrix(rows["features"]))))


def project(reduced: DataFrame, solution: Solution) -> DataFrame:
    """The long table in shared coordinates: all parts, both anchor sets included. A task makes the map of the institution whose rows it has."""
    shared = reduced.sparkSession.sparkContext.broadcast(solution)
    return reduced.groupBy("institution").applyInPandas(partial(_projected, shared=shared), SCHEMA)


def integrate(reduced: DataFrame, p: int, method: str, penalty: float = 0.1, width: str = "auto", width_ratio: float = 1.0, shift: float = 0.0, orthonormal: bool = False, anchor_target: np.ndarray | None = None, selection: str = "forward", selection_ratio: float = 0.5) -> tuple[DataFrame, Solution]:
    """(long table in shared coordinates, solution), with ``solve``'s options, for any number of institutions."""
    how = Method(method, penalty, width, width_ratio)
    if anchor_target is not None and method not in SELECTING:
        raise ValueError(f"only {SELECTING} take a selection by labels")
    if method.startswith("GEP") and (shift or orthonormal):
        solution = solve(images_of(reduced)[0], p, method, shift=shift, orthonormal=orthonormal)
    elif method == "ODC":
        first = reduced.filter("part = 'anchor'").agg(F.min("institution")).first()[0]
        solution = Solution(how, reference=images_of(reduced.filter(F.col("institution") == first))[0][first])
    else:
        anchors, m, _ = anchor_rows(reduced)
        gammas = tuned_widths_of(anchors, how, p, m) if method == "nonlinear_tuning" else {}
        solution = how.solved(summed(anchors, partial(_term, method=how, gammas=gammas)), m, p, anchor_target, selection, selection_ratio)
        solution.gammas = gammas
    return project(reduced, solution), solution


AGREEMENT = "institution int, rank int, size double, least_cosine double, most_cross double, mean double, max double"


def _agreement(rows: pd.DataFrame, shared) -> pd.DataFrame:
    first, first_test = shared.value
    own, test = (matrix(rows[rows["part"] == part].sort_values("row_id")["features"]) for part in ("anchor", "anchor_test"))
    norm = lambda z: z / np.maximum(np.linalg.norm(z, axis=0), 1e-300)
    inner = norm(own).T @ norm(own)
    apart = np.sqrt(((test - first_test) ** 2).sum(axis=1))
    told = {"institution": int(rows["institution"].iloc[0]), "rank": int(np.linalg.matrix_rank(own, tol=1e-8 * max(np.linalg.norm(own, 2), 1e-300))), "size": float((own**2).sum()), "least_cosine": float((norm(own) * norm(first)).sum(axis=0).min()), "most_cross": float(np.abs(inner - np.diag(np.diag(inner))).max(initial=0)), "mean": float(apart.mean()), "max": float(apart.max())}
    return pd.DataFrame([told]).astype({"institution": "int32", "rank": "int32"})


def agreement(shared: DataFrame) -> DataFrame:
    """A row an institution: rank and sum of squares of its integrated anchors, the least cosine of a column with the first institution's, the greatest between two of its
    own, and how far its images of the test anchors are from the first institution's. It grows with the institutions, not with their pairs."""
    anchors = shared.filter(F.col("part").isin("anchor", "anchor_test"))
    least = anchors.agg(F.min("institution")).first()[0]
    first = anchors.filter(F.col("institution") == least).toPandas().sort_values("row_id")  # one institution's anchors
    both = tuple(matrix(first[first["part"] == part]["features"]) for part in ("anchor", "anchor_test"))
    return anchors.groupBy("institution").applyInPandas(partial(_agreement, shared=shared.sparkSession.sparkContext.broadcast(both)), AGREEMENT)


def diagnostics(images: dict[int, np.ndarray], maps: Solution) -> dict[str, float]:
    """Disagreement sum over pairs of |S_i G_i - S_j G_j|^2, mean size of an image, sum and ratio of the eigenvalues."""
    z = [images[i] @ maps.linear[i] for i in sorted(maps.linear)]
    mean = sum(z) / len(z)
    values = maps.values if maps.values is not None else np.array([np.nan])
    return {"disagreement": float(2 * len(z) * sum(((x - mean) ** 2).sum() for x in z)), "mean_norm": float(np.mean([np.linalg.norm(x) for x in z])), "eigen_sum": float(values.sum()), "eigen_ratio": float(values[-1] / values[0]) if values[0] > 0 else float("inf")}
