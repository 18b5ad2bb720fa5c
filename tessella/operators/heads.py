"""Maps trained together with a linear or a logistic head.

The loss is weight_pred times the head's loss over the mapped training rows (their mean), plus weight_reg times the disagreement of the anchors' images, plus
weight_cross times the squared B-products of different columns; columns keep B-norm one, as in ``joint``. The head is eliminated rather than trained beside
the maps (variable projection): for given maps the best linear head solves normal equations, and the best logistic head is where its Newton steps
(reweighted least squares) end. At the best head the loss moves with the maps alone, so its gradient for the maps is that of a fixed head.

Linear head: one Spark job sends X'X, X'Y and Y'Y of each institution; everything after it is algebra on them. Logistic head: each round is one job in which
tasks add up loss, gradient and curvature of the head and the maps' gradients. A tenth of the training rows, drawn by a hash of their ids, takes no part in either
and decides when to stop; the maps that did best on it are kept. Test rows are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integrate import Method, Solution, coordinates_of
from .joint import anchor_blocks, anchor_loss, anchors_start, spread
from .reduce import matrix

HEADS = ("linear_objective", "logistic_objective")
#: Ridge of the heads, on the scale of sums over rows.
HEAD_RIDGE = 1.0


class Anchors:
    """The anchors' part, in coordinates u in which the norm of a column is the plain one. ``n`` anchors, where the images have other rows than theirs."""

    def __init__(self, images: dict[int, np.ndarray], p: int, n: int | None = None) -> None:
        self.a, self.b, self.cuts = anchor_blocks(images)
        self.low, self.p = self.b.cholesky(), p
        self.values, first = anchors_start(images, self.a, self.low, p)
        self.start = self.unit(self.low.T @ first)
        self.scale = float(np.sqrt(sum(n or len(s) for s in images.values())))  # mapped anchors have mean square one at it

    @staticmethod
    def unit(u: np.ndarray) -> np.ndarray:
        return u / np.sqrt(np.maximum((u * u).sum(axis=0), 1e-300))

    def stacked(self, u: np.ndarray) -> np.ndarray:
        return self.low.T.solve(self.unit(u))

    def maps(self, v: np.ndarray) -> dict[int, np.ndarray]:
        """What the heads see: the maps at the scale of the mapped anchors."""
        return {i: self.scale * v[cut] for i, cut in self.cuts.items()}

    def slope(self, u: np.ndarray, dv: np.ndarray) -> np.ndarray:
        """Gradient in u of what has gradient ``dv`` in the stacked maps."""
        size, du = np.sqrt((u * u).sum(axis=0)), self.low.solve(dv)
        n = u / size
        return (du - n * (n * du).sum(axis=0)) / size


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 10, told: Callable[[np.ndarray], bool] | None = None, tolerance: float = 1e-9) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking; ``told`` sees each point and ends it by returning True."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, used = g.copy(), []
        for s, y in reversed(pairs):
            a = (s * d).sum() / (s * y).sum()
            used.append(a)
            d -= a * y
        if pairs:
            s, y = pairs[-1]
            d *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            d += s * (a - (y * d).sum() / (s * y).sum())
        down, step = float((g * d).sum()), 1.0 if pairs else 1.0 / max(float(np.sqrt((g * g).sum())), 1e-300)
        while (new := f(x - step * d))[0] > value - 1e-4 * step * down and step > 1e-12:
            step /= 2
        if step <= 1e-12:
            break
        moved, turned = -step * d, new[1] - g
        if (moved * turned).sum() > 1e-300:
            pairs = [*pairs[-memory + 1 :], (moved, turned)]
        x, old, (value, g) = x + moved, value, new
        if (told and told(x)) or abs(old - value) <= tolerance * max(abs(value), 1e-300):
            break
    return x


class Held:
    """Keeps the point that did best on the held-out rows, and says when there has been none better for a while."""

    def __init__(self, patience: int) -> None:
        self.patience, self.best, self.kept, self.idle = patience, np.inf, None, 0

    def __call__(self, loss: float, point) -> bool:
        if loss < self.best * (1 - 1e-6):
            self.best, self.kept, self.idle = loss, point, 0
        else:
            self.idle += 1
        return self.idle >= self.patience


def targets(y: np.ndarray, n_classes: int) -> np.ndarray:
    """A column a class, or the value itself where there are no classes."""
    return y[:, None].astype(float) if n_classes <= 1 else (y[:, None] == np.arange(n_classes)).astype(float)


# ---- linear head

STATISTICS = "institution int, held boolean, n long, xx array<double>, xy array<double>, yy double"


def _statistics(rows: pd.DataFrame, n_classes: int) -> pd.DataFrame:
    """Sums of one part of an institution's rows."""
    x, y = matrix(rows["features"]), targets(rows["target"].to_numpy(), n_classes)
    return pd.DataFrame({"institution": rows["institution"].iloc[:1], "held": rows["held"].iloc[:1], "n": [len(x)], "xx": [(x.T @ x).ravel()], "xy": [(x.T @ y).ravel()], "yy": [float((y * y).sum())]})


class LinearHead:
    """Loss of the best linear head, from sums alone."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray, float]], ridge: float = HEAD_RIDGE) -> None:
        self.sums, self.ridge = sums, ridge
        self.n, self.yy = max(sum(s[0] for s in sums.values()), 1), sum(s[3] for s in sums.values())

    def normal(self, maps: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Z'Z and Z'Y of the mapped rows."""
        return sum(maps[i].T @ xx @ maps[i] for i, (_, xx, _, _) in self.sums.items()), sum(maps[i].T @ xy for i, (_, _, xy, _) in self.sums.items())

    def best(self, maps: dict[int, np.ndarray]) -> np.ndarray:
        zz, zy = self.normal(maps)
        return np.linalg.solve(zz + self.ridge * np.eye(len(zz)), zy)

    def loss(self, maps: dict[int, np.ndarray], head: np.ndarray) -> float:
        zz, zy = self.normal(maps)
        return float(self.yy - 2 * (head * zy).sum() + (head * (zz @ head)).sum()) / self.n

    def loss_and_gradients(self, maps: dict[int, np.ndarray]) -> tuple[float, dict[int, np.ndarray], np.ndarray]:
        """(mean square with the ridge's part, its gradient for each map, the best head)."""
        head = self.best(maps)
        value = self.loss(maps, head) + self.ridge * float((head**2).sum()) / self.n
        return value, {i: 2 / self.n * (xx @ maps[i] @ head - xy) @ head.T for i, (_, xx, xy, _) in self.sums.items()}, head


def _train(reduced: DataFrame, seed: int) -> DataFrame:
    held = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(10)) == 0
    return reduced.filter((F.col("part") == "train") & F.col("target").isNotNull()).select("institution", held.alias("held"), "target", "features")


def linear_maps(reduced: DataFrame, p: int, n_classes: int, weight_pred: float = 1.0, weight_reg: float = 1.0, weight_cross: float = 0.0, rounds: int = 200, patience: int = 10, seed: int = 0) -> tuple[Solution, dict]:
    """(solution, what came of it: losses of training and held-out rows at the start and at the end, head, rows)."""
    images, n_anchors = coordinates_of(reduced)
    anchors = Anchors(images, p, n_anchors)
    found = _train(reduced, seed).groupBy("institution", "held").applyInPandas(partial(_statistics, n_classes=n_classes), STATISTICS).toPandas()  # two rows an institution
    q = max(n_classes, 1)
    of = lambda part: LinearHead({int(r.institution): (int(r.n), np.reshape(r.xx, (-1, len(r.xy) // q)), np.reshape(r.xy, (-1, q)), float(r.yy)) for r in part.itertuples()})
    own, held = of(found[~found["held"]]), of(found[found["held"]])
    stop = Held(patience)

    def f(u: np.ndarray) -> tuple[float, np.ndarray]:
        v = anchors.stacked(u)
        value, dv = anchor_loss(v, anchors.a, anchors.b, weight_reg, weight_cross)
        if weight_pred and own.sums:
            loss, gradients, _ = own.loss_and_gradients(anchors.maps(v))
            value += weight_pred * loss
            for i, g in gradients.items():
                dv[anchors.cuts[i]] += weight_pred * anchors.scale * g
        return value, anchors.slope(u, dv)

    def told(u: np.ndarray) -> bool:
        maps = anchors.maps(anchors.stacked(u))
        return stop(held.loss(maps, own.best(maps)) if held.sums else f(u)[0], u)

    told(anchors.start)
    first = stop.best
    last = lbfgs(f, anchors.start, rounds, told=told)
    u = stop.kept if stop.kept is not None else last
    v = anchors.stacked(u)
    maps = anchors.maps(v)
    result = {"start": f(anchors.start)[0], "end": f(u)[0], "held_start": first, "held_end": stop.best, "head": own.best(maps), "n": own.n + sum(s[0] for s in held.sums.values()), "own": own, "maps": maps, "norms": (v * (anchors.b @ v)).sum(axis=0)}
    return Solution(Method("GEP"), linear={i: v[cut] for i, cut in anchors.cuts.items()}, values=anchors.values), result


# ---- logistic head

def logistic_sums(head: np.ndarray, g: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(cross entropy, its gradient and curvature for the head, its gradient for the map), summed over the rows. head: (p + 1) x classes, the last row the offsets."""
    z = np.hstack([x @ g, np.ones((len(x), 1))])
    s = z @ head
    s -= s.max(axis=1, keepdims=True)
    p = np.exp(s)
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    d = p.copy()
    d[np.arange(len(y)), y] -= 1
    side, c = z.shape[1], head.shape[1]
    curve = np.zeros((c, side, c, side))
    for i in range(c):
        for j in range(i, c):
            block = z.T @ (z * (p[:, i] * ((i == j) - p[:, j]))[:, None])
            curve[i, :, j], curve[j, :, i] = block, block
    return float(loss), z.T @ d, curve.reshape(c * side, c * side), x.T @ d @ head[:-1].T


def _logistic_task(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    head, maps = shared.value
    n, loss, slope, curve, n_held, loss_held, own = 0, 0.0, 0.0, 0.0, 0, 0.0, {}
    for f in frames:
        for (i, held), rows in f.groupby(["institution", "held"]):
            more, dh, ch, dg = logistic_sums(head, maps[i], matrix(rows["features"]), rows["target"].to_numpy())
            if held:
                n_held, loss_held = n_held + len(rows), loss_held + more
            else:
                n, loss, slope, curve = n + len(rows), loss + more, slope + dh, curve + ch
                own[i] = own.get(i, 0) + dg
    if n + n_held:
        both = np.concatenate([np.ravel(slope), np.ravel(curve)]) if n else np.zeros(0)
        yield pd.DataFrame([(-1, n, loss, n_held, loss_held, both), *((int(i), 0, 0.0, 0, 0.0, g.ravel()) for i, g in own.items())], columns=["institution", "n", "loss", "n_held", "loss_held", "sums"])


def logistic_maps(reduced: DataFrame, p: int, n_classes: int, weight_pred: float = 1.0, weight_reg: float = 1.0, weight_cross: float = 0.0, rounds: int = 60, rate: float = 2e-3, patience: int = 8, seed: int = 0, newton: int = 8) -> tuple[Solution, dict]:
    """(solution, what came of it). The first ``newton`` rounds move the head alone, until it is the best for the starting maps; then each round takes a
    Newton step of the head and a step of the maps along the gradient in which the head is the best one."""
    images, n_anchors = coordinates_of(reduced)
    anchors = Anchors(images, p, n_anchors)
    context = reduced.sparkSession.sparkContext
    rows = spread(_train(reduced, seed))
    head, u, side = np.zeros((p + 1, n_classes)), anchors.start, p + 1
    m, s, stop, log, turn = np.zeros_like(u), np.zeros_like(u), Held(patience), [], 0
    for turn in range(newton + rounds):
        v = anchors.stacked(u)
        shared = context.broadcast((head, anchors.maps(v)))
        found = rows.mapInPandas(partial(_logistic_task, shared=shared), "institution int, n long, loss double, n_held long, loss_held double, sums array<double>").toPandas()  # sums: a row a task, and one for each of its institutions
        shared.unpersist()
        n = max(int(found["n"].sum()), 1)
        value, dv = anchor_loss(v, anchors.a, anchors.b, weight_reg, weight_cross)
        value += weight_pred * (float(found["loss"].sum()) + 0.5 * HEAD_RIDGE * float((head**2).sum())) / n
        total = [np.asarray(x) for i, x in zip(found["institution"], found["sums"], strict=True) if i < 0 and len(x)]
        sums = np.sum(total, axis=0) if total else np.zeros(side * n_classes * (1 + side * n_classes))
        slope = sums[: side * n_classes].reshape(side, n_classes) + HEAD_RIDGE * head
        curve = sums[side * n_classes :].reshape(side * n_classes, -1) + HEAD_RIDGE * np.eye(side * n_classes)
        for i, g in zip(found["institution"], found["sums"], strict=True):
            if i >= 0:
                dv[anchors.cuts[int(i)]] += weight_pred * anchors.scale / n * np.asarray(g).reshape(-1, p)
        held = float(found["loss_held"].sum()) / max(int(found["n_held"].sum()), 1)
        log.append((value, held, float(np.abs(slope).max())))
        if turn >= newton and stop(held if found["n_held"].sum() else value, (u, head)):
            break
        head = head - np.linalg.solve(curve, slope.T.ravel()).reshape(n_classes, side).T
        if turn >= newton:
            g, t = anchors.slope(u, dv), turn - newton + 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            u = anchors.unit(u - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-12))
    u, head = stop.kept if stop.kept is not None else (u, head)
    v = anchors.stacked(u)
    return Solution(Method("GEP"), linear={i: v[cut] for i, cut in anchors.cuts.items()}, values=anchors.values), {"log": log, "head": head, "held_start": log[min(newton, len(log) - 1)][1], "held_end": stop.best, "newton_slope": log[min(newton, len(log) - 1)][2], "norms": (v * (anchors.b @ v)).sum(axis=0)}


def head_maps(reduced: DataFrame, p: int, n_classes: int, head: str, **settings) -> tuple[Solution, dict]:
    if head not in HEADS:
        raise ValueError(f"unknown head {head!r}: one of {HEADS}")
    return (linear_maps if head == "linear_objective" else logistic_maps)(reduced, p, n_classes, **settings)
