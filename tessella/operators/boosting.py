"""Boosted regression trees over five folds, and a search of their settings.

All models that are in training, every trial times every fold, grow level by level in the same jobs: a task bins its rows' residuals once for each model, the sums
of a model's histograms are added up by Spark, and the driver picks the splits. Trees see bins alone, so training rows of one fold with equal bins are one group with their number, mean
and squares about it, which loses nothing of the sums. Groups carry each model's prediction so far, so a round costs as much as its own tree.

Settings come from a tree-structured Parzen sampler: finished trials are divided into the best tenth, two at least, and the rest, each parameter's values in both are
smoothed into densities, and of some draws from the better one that is tried next for which the ratio of both is greatest. Trials run in generations; within one, those
whose error on the held-out folds is above the median of all trials at the same round stop early.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stable

BINS, FOLDS = 64, 5
#: Rounds after which trials are compared.
RUNGS = (2, 4, 8, 16, 32, 64)


@dataclass(frozen=True)
class Parameter:
    """One setting: its range, on a log scale if asked, whole numbers if asked."""

    name: str
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def value(self, unit: float) -> float:
        lo, hi = (np.log(self.low), np.log(self.high)) if self.log else (self.low, self.high)
        x = lo + unit * (hi - lo)
        x = float(np.exp(x)) if self.log else float(x)
        return float(int(min(max(round(x), self.low), self.high))) if self.whole else x


SPACE = (Parameter("rate", 0.02, 0.6, log=True), Parameter("depth", 1, 3, whole=True), Parameter("ridge", 0.01, 100.0, log=True), Parameter("least_rows", 1, 50, log=True, whole=True))


class Sampler:
    """Settings to try, as points of the unit cube; lesser scores are better."""

    def __init__(self, n: int, seed: int = 0, first: int = 8, share: float = 0.1, draws: int = 24) -> None:
        self.rng, self.n, self.first, self.share, self.draws = np.random.default_rng(seed), n, first, share, draws
        self.points: list[np.ndarray] = []
        self.scores: list[float] = []

    @staticmethod
    def widths(centres: np.ndarray) -> np.ndarray:
        """Each bell is as wide as the larger gap beside its centre, and not narrower than the number of centres warrants."""
        order = np.argsort(centres)
        gaps = np.diff(np.concatenate([[0.0], centres[order], [1.0]]))
        out = np.empty_like(centres)
        out[order] = np.clip(np.maximum(gaps[:-1], gaps[1:]), 0.5 / min(100, len(centres) + 1), 1.0)
        return out

    @staticmethod
    def density(x: np.ndarray, centres: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """Bells cut to [0, 1] at the centres, and one flat part, all of equal weight."""
        erf = lambda t: np.sign(t) * np.sqrt(1 - np.exp(-t * t * (4 / np.pi + 0.147 * t * t) / (1 + 0.147 * t * t)))
        inside = 0.5 * (erf((1 - centres) / (widths * 2**0.5)) - erf(-centres / (widths * 2**0.5)))
        bells = np.exp(-0.5 * ((x[:, None] - centres) / widths) ** 2) / (widths * (2 * np.pi) ** 0.5 * inside)
        return (bells.sum(axis=1) + 1) / (len(centres) + 1)

    def ask(self) -> np.ndarray:
        if len(self.points) < self.first:
            return self.rng.random(self.n)
        order = np.argsort(self.scores, kind="stable")
        n_good = max(2, int(np.ceil(self.share * len(order))))
        x, out = np.array(self.points), np.empty(self.n)
        for c in range(self.n):
            good, bad = x[order[:n_good], c], x[order[n_good:], c]
            wide, own = self.widths(good), self.rng.integers(len(good), size=self.draws)
            at = good[own] + wide[own] * self.rng.normal(size=self.draws)
            at = at - 2 * np.floor(at / 2)
            at = np.where(at > 1, 2 - at, at)  # folded back into the range
            out[c] = at[(self.density(at, good, wide) / self.density(at, bad, self.widths(bad))).argmax()]
        return out

    def tell(self, point: np.ndarray, score: float) -> None:
        self.points.append(point)
        self.scores.append(score)


@dataclass
class Model:
    """One trial without one fold."""

    trial: int
    fold: int
    rate: float
    depth: int
    ridge: float
    least_rows: int
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature (-1: leaf), bin, value; in heap order


def nodes_of(bins: np.ndarray, feature: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(levels):
        f = feature[node]
        right = bins[rows, np.maximum(f, 0)] > at[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def predicted(bins: np.ndarray, trees: list) -> np.ndarray:
    out = np.zeros(len(bins))
    for feature, at, value in trees:
        out += value[nodes_of(bins, feature, at, int(np.log2(len(feature) + 1)) - 1)]
    return out


def _binned(frames: Iterator[pd.DataFrame], edges: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    for f in frames:
        x = np.array(f["features"].tolist(), float).reshape(len(f), -1)
        b = np.stack([np.searchsorted(e, x[:, c], "left") for c, e in enumerate(edges)], axis=1).astype(np.uint8) if len(f) else x
        yield f.drop(columns="features").assign(bins=[r.tobytes() for r in b])


def _bins(f: pd.DataFrame, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(f["bins"]), np.uint8).reshape(len(f), d)


def _histograms(frames: Iterator[pd.DataFrame], shared, d: int) -> Iterator[pd.DataFrame]:
    """One task's sums for each model: residuals and rows by open node, feature and bin."""
    models, level = shared.value
    total: dict[int, np.ndarray] = {}
    for f in frames:
        bins, y, n, fold = _bins(f, d), f["y"].to_numpy(float), f["n"].to_numpy(float), f["fold"].to_numpy()
        so_far = np.array(f["scores"].tolist(), float).reshape(len(f), -1)
        for m, (model, tree) in models.items():
            own = fold != model.fold
            node = nodes_of(bins[own], tree[0], tree[1], level) - (2**level - 1)
            g = (n * (y - so_far[:, m]))[own]
            open_ = node >= 0  # others ended in a leaf above
            flat = ((node[open_, None] * d + np.arange(d)) * BINS + bins[own][open_]).ravel()
            sums = np.stack([np.bincount(flat, w, minlength=2**level * d * BINS) for w in (np.repeat(g[open_], d), np.repeat(n[own][open_], d))])
            total[m] = total.get(m, 0) + sums
    if total:
        yield pd.DataFrame({"m": list(total), "v": [t.ravel() for t in total.values()]})


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"m": rows["m"].iloc[:1], "v": [np.sum(rows["v"].tolist(), axis=0)]})


def _scored(frames: Iterator[pd.DataFrame], shared, d: int) -> Iterator[pd.DataFrame]:
    """Predictions with the newest trees added."""
    for f in frames:
        s, bins = np.array(f["scores"].tolist(), float).reshape(len(f), -1), _bins(f, d)
        for m, tree in shared.value.items():
            s[:, m] += predicted(bins, [tree])
        yield f.assign(scores=list(s))


def _held(frames: Iterator[pd.DataFrame], folds: list[int]) -> Iterator[pd.DataFrame]:
    """One task's squared errors of each model on the fold it does not know."""
    out = np.zeros((len(folds), 2))
    for f in frames:
        s, y, n, within, fold = np.array(f["scores"].tolist(), float).reshape(len(f), -1), *(f[c].to_numpy(float) for c in ("y", "n", "within")), f["fold"].to_numpy()
        for m, own in enumerate(folds):
            here = fold == own
            out[m] += [(within[here] + n[here] * (y[here] - s[here, m]) ** 2).sum(), n[here].sum()]
    yield pd.DataFrame({"m": np.arange(len(folds)), "square": out[:, 0], "n": out[:, 1].astype(np.int64)})


def grown(sums: np.ndarray, model: Model, tree: tuple, level: int, d: int) -> None:
    """Splits the open nodes of a level where that gains; others become leaves."""
    feature, at, value = tree
    g, n = sums.reshape(2, 2**level, d, BINS)
    for node in range(2**level):
        place = 2**level - 1 + node
        total, count = g[node, 0].sum(), n[node, 0].sum()
        if not count:
            continue
        value[place] = model.rate * total / (count + model.ridge)
        if level == model.depth:
            continue
        left, n_left = g[node].cumsum(axis=1), n[node].cumsum(axis=1)
        gain = left**2 / (n_left + model.ridge) + (total - left) ** 2 / (count - n_left + model.ridge) - total**2 / (count + model.ridge)
        gain = np.where((n_left >= model.least_rows) & (count - n_left >= model.least_rows), gain, -np.inf)
        best = int(gain.argmax())
        if gain.ravel()[best] > 1e-9 * max(abs(total), 1.0):
            feature[place], at[place] = divmod(best, BINS)


class Boosting:
    """Training rows in bins, and the models that are trained on them side by side."""

    def __init__(self, rows: DataFrame, seed: int = 0, folds: int = FOLDS) -> None:
        """rows: (row_id, y, features without nulls). The fold of a row is a hash of its id, the same for every trial."""
        self.spark = rows.sparkSession
        self.d = rows.agg(F.max(F.size("features"))).first()[0]
        cuts = [F.percentile_approx(F.col("features")[c], [float(q) for q in np.arange(1, BINS) / BINS], 10_000).alias(f"c{c}") for c in range(self.d)]
        self.edges = [np.unique(v) for v in rows.agg(*cuts).first()]  # a few numbers a feature
        fold = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(folds)).cast("int")
        self.rows = self.binned(rows.select("row_id", F.col("y").cast("double").alias("y"), fold.alias("fold"), F.col("features").cast("array<double>").alias("features")))
        n = F.count(F.lit(1))
        self.groups = stable(self.rows.groupBy("fold", "bins").agg(n.alias("n"), F.avg("y").alias("y"), (F.var_pop("y") * n).alias("within")))
        means = {r["fold"]: (r["s"], r["n"]) for r in self.groups.groupBy("fold").agg(F.sum(F.col("y") * F.col("n")).alias("s"), F.sum("n").alias("n")).collect()}
        whole, n = sum(s for s, _ in means.values()), sum(n for _, n in means.values())
        self.base = {k: (whole - means.get(k, (0, 0))[0]) / max(n - means.get(k, (0, 0))[1], 1) for k in range(folds)}
        self.folds = folds

    def binned(self, rows: DataFrame) -> DataFrame:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "features")
        return rows.mapInPandas(partial(_binned, edges=self.edges), f"{kinds}, bins binary")

    def train(self, settings: dict[int, dict], rounds: int, history: dict[int, list[float]]) -> tuple[list[Model], dict[int, dict]]:
        """(models, outcome of each trial: rounds, rmse, pruned). ``history``: at each rung, the errors of earlier trials; grows by these."""
        models = [Model(t, k, s["rate"], int(s["depth"]), s["ridge"], int(s["least_rows"]), self.base[k]) for t, s in settings.items() for k in range(self.folds)]
        context, kinds = self.spark.sparkContext, "fold int, bins binary, n long, y double, within double, scores array<double>"
        state = self.groups.withColumn("scores", F.array(*[F.lit(float(m.base)) for m in models]))
        best = {t: (np.inf, 0) for t in settings}
        live, outcome = set(settings), {t: {"rounds": rounds, "pruned": False} for t in settings}
        for turn in range(1, rounds + 1):
            active = {i: m for i, m in enumerate(models) if m.trial in live}
            fresh = {i: (np.full(2 ** (m.depth + 1) - 1, -1), np.zeros(2 ** (m.depth + 1) - 1, np.int64), np.zeros(2 ** (m.depth + 1) - 1)) for i, m in active.items()}
            for level in range(1 + max(m.depth for m in active.values())):
                here = {i: (m, fresh[i]) for i, m in active.items() if m.depth >= level and (level == 0 or (fresh[i][0][2 ** (level - 1) - 1 : 2**level - 1] >= 0).any())}
                if not here:
                    break
                shared = context.broadcast((here, level))
                found = state.mapInPandas(partial(_histograms, shared=shared, d=self.d), "m int, v array<double>").groupBy("m").applyInPandas(_added, "m int, v array<double>")
                for r in found.toLocalIterator():  # a model's sums at a time
                    grown(np.asarray(r["v"]), models[r["m"]], fresh[r["m"]], level, self.d)
                shared.unpersist()
            for i, tree in fresh.items():
                models[i].trees.append(tree)
            state = state.mapInPandas(partial(_scored, shared=context.broadcast(fresh), d=self.d), kinds)
            state = stable(state)
            errors = state.mapInPandas(partial(_held, folds=[m.fold for m in models]), "m int, square double, n long").groupBy("m").agg(F.sum("square").alias("s"), F.sum("n").alias("n")).toPandas().set_index("m")
            rmse = {t: float(np.sqrt(sum(errors.loc[i, "s"] for i, m in enumerate(models) if m.trial == t) / max(sum(errors.loc[i, "n"] for i, m in enumerate(models) if m.trial == t), 1))) for t in live}
            for t, e in rmse.items():
                best[t] = min(best[t], (e, turn))
            if turn in RUNGS and turn < rounds:
                known = history.setdefault(turn, [])
                known += rmse.values()
                for t in [t for t in live if rmse[t] > np.median(known) and len(live) > 1]:
                    live.discard(t)
                    outcome[t] = {"rounds": turn, "pruned": True}
        for t in settings:
            outcome[t] |= {"rmse": best[t][0], "best_round": best[t][1]}
        for m in models:
            m.trees = m.trees[: best[m.trial][1]]
        return models, outcome

    def predict(self, rows: DataFrame, models: list[Model]) -> DataFrame:
        """``rows`` (with features) and prediction: the mean of the folds' models."""
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        shared = self.spark.sparkContext.broadcast((self.edges, models))
        return rows.mapInPandas(partial(_mean_prediction, shared=shared), f"{kinds}, prediction double")


def _mean_prediction(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    edges, models = shared.value
    for f in frames:
        if len(f):
            b = _bins(next(_binned(iter([f]), edges)), len(edges))
            yield f.assign(prediction=np.mean([m.base + predicted(b, m.trees) for m in models], axis=0))


def tuned(rows: DataFrame, generations: int = 2, trials: int = 4, rounds: int = 8, seed: int = 0, space: Sequence[Parameter] = SPACE, sampler: Callable[..., Sampler] = Sampler) -> tuple[Boosting, list[Model], list[dict]]:
    """(training, models of the best trial, every trial with its settings and outcome)."""
    boosting, ask = Boosting(rows, seed), sampler(len(space), seed, first=trials)
    told, best, history = [], ([], np.inf), {}
    for generation in range(generations):
        points = {generation * trials + i: ask.ask() for i in range(trials)}
        settings = {t: {p.name: p.value(u) for p, u in zip(space, point, strict=True)} for t, point in points.items()}
        models, outcome = boosting.train(settings, rounds, history)
        for t, point in points.items():
            ask.tell(point, outcome[t]["rmse"])
            told.append({"trial": t, "generation": generation, **settings[t], **outcome[t]})
            if outcome[t]["rmse"] < best[1]:
                best = [m for m in models if m.trial == t], outcome[t]["rmse"]
    return boosting, best[0], told
