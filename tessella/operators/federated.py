"""Federated averaging: parameters travel, rows do not.

Each round broadcasts the parameters, every institution trains on its own rows in a grouped map, and the new parameters
are averaged position by position in Spark. The scaler comes from sums and sums of squares of the institutions.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stable
from .reduce import matrix

HIDDEN, ROUNDS, LOCAL_EPOCHS, RATE = 256, 10, 5, 0.01


def unpack(flat: np.ndarray, d: int, h: int, c: int) -> list[np.ndarray]:
    parts, at = [], 0
    for shape in ((d, h), (h,), (h, c), (c,)):
        n = int(np.prod(shape))
        parts.append(flat[at : at + n].reshape(shape))
        at += n
    return parts


def start(d: int, h: int, c: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.normal(size=(d, h)) * np.sqrt(2 / d)).ravel(), np.zeros(h), (rng.normal(size=(h, c)) * np.sqrt(2 / h)).ravel(), np.zeros(c)])


def forward(flat: np.ndarray, x: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = unpack(flat, *shape)
    h = np.maximum(x @ w1 + b1, 0)
    z = h @ w2 + b2
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return h, p / p.sum(axis=1, keepdims=True)


def local_steps(flat: np.ndarray, x: np.ndarray, y: np.ndarray, shape: tuple[int, int, int], epochs: int, rate: float) -> np.ndarray:
    """Full-batch gradient steps of the cross entropy."""
    flat = flat.copy()
    for _ in range(epochs):
        h, p = forward(flat, x, shape)
        _, _, w2, _ = unpack(flat, *shape)
        d = p
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ w2.T) * (h > 0)
        flat -= rate * np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), (h.T @ d).ravel(), d.sum(axis=0)])
    return flat


def _client(rows: pd.DataFrame, shared, shape, epochs: int, rate: float) -> pd.DataFrame:
    flat, mean, sigma = shared.value
    new = local_steps(flat, (matrix(rows["features"]) - mean) / sigma, rows["target"].to_numpy(), shape, epochs, rate)
    return pd.DataFrame({"institution": [int(rows["institution"].iloc[0])], "params": [new]})


def _scored(frames, shared, shape):
    flat, mean, sigma = shared.value
    for f in frames:
        if len(f):
            _, p = forward(flat, (matrix(f["features"]) - mean) / sigma, shape)
            yield f[["institution", "row_id", "target"]].assign(scores=list(p), predicted=p.argmax(axis=1).astype(np.int32))


def adam_epochs(flat: np.ndarray, x: np.ndarray, y: np.ndarray, shape: tuple[int, int, int], epochs: int, seed: int, rate: float = 1e-3, size: int = 200) -> np.ndarray:
    """Mini-batch Adam steps of the cross entropy."""
    rng, flat = np.random.default_rng(seed), flat.copy()
    m, v, t = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), size):
            some = order[lo : lo + size]
            g = flat - local_steps(flat, x[some], y[some], shape, 1, 1.0)  # the gradient itself
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return flat


def _trained_part(rows: pd.DataFrame, shared, shape, epochs: int) -> pd.DataFrame:
    """One part's parameters after its epochs, and how the parameters that came did on its validation rows."""
    flat, turn = shared.value
    x, y, held = matrix(rows["features"]), rows["target"].to_numpy(), rows["held"].to_numpy()
    right = int((forward(flat, x[held], shape)[1].argmax(axis=1) == y[held]).sum()) if held.any() else 0
    own = ~held
    new = adam_epochs(flat, x[own], y[own], shape, epochs, 1000 * turn + int(rows["part_no"].iloc[0])) if own.any() else flat
    return pd.DataFrame({"n": [int(own.sum())], "held": [int(held.sum())], "right": [right], "params": [new]})


def relu_network(train: DataFrame, test: DataFrame, n_classes: int, seed: int = 0, hidden: int = HIDDEN, part_rows: int = 5000, max_parts: int = 64, max_rounds: int = 40, epochs: int = 5, patience: int = 2) -> DataFrame:
    """``test`` with scores and predicted, by one hidden relu layer that stops early on a tenth of the training rows.

    Rows (row_id, target, features, already scaled) lie in parts by a hash. Each round every part goes through its rows ``epochs`` times from the same
    parameters, which are then averaged by rows; one part alone is plain Adam. ``patience`` rounds without gain (ten epochs) end it, and the best parameters stay.
    """
    context = train.sparkSession.sparkContext
    n, width = train.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    if not n:
        return test.withColumn("scores", F.lit(None).cast("array<double>")).withColumn("predicted", F.lit(None).cast("int"))
    parts = max(1, min(max_parts, n // part_rows))
    drawn = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(10)) == 0
    rows = stable(train.select(F.pmod(F.xxhash64("row_id", F.lit(seed + 1)), F.lit(parts)).cast("int").alias("part_no"), drawn.alias("held"), "target", "features"))
    shape = (width, hidden, n_classes)
    flat = start(*shape, seed)
    best, best_score, idle = flat, -1.0, 0
    for turn in range(max_rounds + 1):
        shared = context.broadcast((flat, turn))
        found = rows.groupBy("part_no").applyInPandas(partial(_trained_part, shared=shared, shape=shape, epochs=epochs), "n long, held long, right long, params array<double>").toPandas()  # one row a part
        score = found["right"].sum() / max(found["held"].sum(), 1)
        if score > best_score + 1e-4:
            best, best_score, idle = flat, score, 0
        else:
            idle += 1
        if idle > patience:
            break
        flat = np.average(np.stack(found["params"].to_list()), axis=0, weights=np.maximum(found["n"], 1e-9))
        shared.unpersist()
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in test.schema]
    return test.mapInPandas(partial(_network_scores, shared=context.broadcast(best), shape=shape), ", ".join([*kinds, "scores array<double>, predicted int"]))


def _network_scores(frames, shared, shape):
    for f in frames:
        if len(f):
            p = forward(shared.value, matrix(f["features"]), shape)[1]
            yield f.assign(scores=list(p), predicted=p.argmax(axis=1).astype(np.int32))


def federated(rows: DataFrame, n_classes: int, seed: int = 42, rounds: int = ROUNDS, local_epochs: int = LOCAL_EPOCHS, rate: float = RATE, hidden: int = HIDDEN) -> DataFrame:
    """Test rows with scores of the averaged network; rows: (institution, part, row_id, target, features)."""
    context = rows.sparkSession.sparkContext
    train = rows.filter("part = 'train'").select("institution", "target", "features")
    local = train.select("institution", F.posexplode("features").alias("i", "x")).groupBy("institution", "i").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    means = local.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    off = F.col("m") - F.col("mean")
    sums = local.join(means, "i").groupBy("i").agg(F.first("mean").alias("mean"), (F.sum(F.col("n") * (F.col("v") + off * off)) / F.sum("n")).alias("var")).orderBy("i").toPandas()  # one row per dimension
    mean, sigma = sums["mean"].to_numpy(), np.sqrt(sums["var"]).to_numpy()
    sigma[sigma == 0] = 1
    shape = (len(mean), hidden, n_classes)
    flat = start(*shape, seed)
    for _ in range(rounds):
        shared = context.broadcast((flat, mean, sigma))
        new = train.groupBy("institution").applyInPandas(partial(_client, shared=shared, shape=shape, epochs=local_epochs, rate=rate), "institution int, params array<double>")
        averaged = new.select(F.posexplode("params").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").toPandas()
        flat = averaged["v"].to_numpy()
        shared.unpersist()
    test = rows.filter("part = 'test'").select("institution", "row_id", "target", "features")
    return test.mapInPandas(partial(_scored, shared=context.broadcast((flat, mean, sigma)), shape=shape), "institution int, row_id long, target int, scores array<double>, predicted int")
