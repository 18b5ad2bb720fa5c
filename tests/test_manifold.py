"""Autoencoder gradients and error, the neighbour graph and its layout."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.operators import manifold as mf


def table(spark, x, y=None):
    return spark.createDataFrame([(i, "train" if i % 4 else "test", [float(v) for v in r], int(y[i]) if y is not None else 0) for i, r in enumerate(x)], "key long, part string, features array<double>, label int").repartition(3)


def bent(n, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.uniform(-2, 2, n)
    return np.stack([t, t * t - 1, np.sin(2 * t), 0.5 * t**3 / 3], axis=1) + 0.02 * rng.normal(size=(n, 4))


def test_autoencoder_gradients_against_differences():
    rng = np.random.default_rng(1)
    w = {"V": rng.normal(size=(5, 2)), "A": rng.normal(size=(5, 4)), "a": rng.normal(size=4), "B": rng.normal(size=(4, 2)), "c": rng.normal(size=4)}
    x = rng.normal(size=(7, 5))
    error, g = mf.error_and_gradients(w, x)
    assert np.isclose(error, ((mf.decoded(w, mf.encoded(w, x)) - x) ** 2).sum())
    for name, value in w.items():
        at = np.unravel_index(value.size // 2, value.shape)
        moved = []
        for h in (1e-6, -1e-6):
            v = value.copy()
            v[at] += h
            moved.append(mf.error_and_gradients({**w, name: v}, x)[0])
        assert np.isclose((moved[0] - moved[1]) / 2e-6, g[name][at], rtol=1e-5), name


def test_autoencoder_starts_from_the_components_and_beats_them(spark):
    x = bent(240)
    out, errors = mf.autoencoder(table(spark, x), 1, hidden=12, rounds=25)
    train = x[np.arange(240) % 4 > 0]
    centred = train - train.mean(axis=0)
    rest = (centred**2).sum() - np.linalg.svd(centred, compute_uv=False)[0] ** 2
    assert np.isclose(errors[0], rest / len(train), rtol=1e-6) and min(errors) < 0.7 * errors[0]
    rows = out.collect()
    assert len(rows) == 240 and all(len(r["features"]) == 1 for r in rows) and out.columns == ["key", "part", "features", "label"]


def test_graph_weights_and_labels(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 3)), np.arange(60) % 2
    rows = table(spark, x, y).select("key", "features", "label")
    graph = {(r["i"], r["j"]): r["w"] for r in mf.neighbour_graph(rows, 6).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :6]
    one = np.zeros((60, 60))
    for i in range(60):
        lo, hi = 1e-6, 1e3
        for _ in range(100):
            s = (lo * hi) ** 0.5
            lo, hi = (lo, s) if np.exp(-(d[i, near[i]] - d[i, near[i, 0]]) / s).sum() > np.log2(6) else (s, hi)
        one[i, near[i]] = np.exp(-(d[i, near[i]] - d[i, near[i, 0]]) / s)
    united = one + one.T - one * one.T
    assert all(np.isclose(graph.get((i, j), 0.0), united[i, j], atol=1e-4) for i in range(60) for j in range(60) if i != j)
    weaker = {(r["i"], r["j"]): r["w"] for r in mf.neighbour_graph(rows, 6, "label", 0.5).collect()}
    assert all(np.isclose(w, graph[e] * (1 if (e[0] + e[1]) % 2 == 0 else np.exp(-5)), rtol=1e-6) for e, w in weaker.items())
    a, b = mf.curve(0.1)
    assert abs(a - 1.58) < 0.1 and abs(b - 0.9) < 0.05


def test_layout_is_more_trustworthy_than_components(spark):
    rng = np.random.default_rng(3)
    centre = 3 * rng.normal(size=(8, 10))
    y = np.arange(120) % 8
    x = centre[y] + rng.normal(size=(120, 10))
    rows = table(spark, x, y).select("key", "features", "label")
    places = mf.layout(rows, 2, k=10, rounds=15)
    found = np.array([r["place"] for r in places.orderBy("key").collect()])
    centred = x - x.mean(axis=0)
    components = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert found.shape == (120, 2) and np.isfinite(found).all()
    assert mf.trustworthiness(x, found, 10) >= mf.trustworthiness(x, components, 10)
    new = spark.createDataFrame([(1000 + c, [float(v) for v in centre[c]]) for c in range(8)], "key long, features array<double>")
    at = np.array([r["place"] for r in mf.placed(new, rows, places, 10).orderBy("key").collect()])
    nearest = ((at[:, None] - found[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (y[nearest] == np.arange(8)).mean() >= 0.75


def test_memberships_of_all_rows_are_searched_side_by_side():
    rng = np.random.default_rng(1)
    squares = [np.sort(rng.random(n)) * (n != 6) for n in (15, 1, 7, 6, 15)]
    frame = pd.DataFrame({"key": [10, 11, 12, 13, 14], "others": [np.arange(len(v)) for v in squares], "squares": squares})
    calls, plain = [], np.exp
    try:
        np.exp = lambda a: calls.append(1) or plain(a)
        (out,) = mf._memberships(iter([frame, frame[:0]]))
    finally:
        np.exp = plain
    half = len(out) // 2
    assert len(calls) <= 65 and half == 44 and (out["i"][half:].to_numpy() == out["j"][:half].to_numpy()).all() and (out["w"][half:].to_numpy() == out["w"][:half].to_numpy()).all()
    sums = out[:half].groupby("i")["w"].sum()
    assert np.allclose(sums[[10, 12, 14]], np.log2([15, 7, 15]), atol=1e-4) and sums[11] == 1 and sums[13] == 6
