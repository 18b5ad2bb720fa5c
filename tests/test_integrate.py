"""Integration by summed terms: equal to dense solves, for thousands of institutions, and told apart from wrong maps."""

import duckdb
import numpy as np
import pytest

from tessella import method_queries  # noqa: F401
from tessella.functions import linalg as la
from tessella.operators import integrate as ig
from tessella.queries import ORACLES, QUERIES
from tessella.sources.synthetic import random_images, related_images


def long_table(spark, images, gamma=float("nan"), extra=3):
    """Anchors and a few rows of each institution."""
    rows = [(i, "anchor", r, -1, [float(v) for v in x], gamma) for i, s in images.items() for r, x in enumerate(s)]
    rows += [(i, part, r, -1, [float(v) for v in x], gamma) for i, s in images.items() for part in ("anchor_test", "train") for r, x in enumerate(1.5 * s[:extra])]
    return spark.createDataFrame(rows, ig.SCHEMA).repartition(5)


def images_in(shared, part="anchor"):
    out = {}
    for r in shared.filter(f"part = '{part}'").orderBy("institution", "row_id").collect():
        out.setdefault(r["institution"], []).append(r["features"])
    return {i: np.array(v) for i, v in out.items()}


def aligned(a, b):
    return a * np.sign((a * b).sum(axis=0))


@pytest.mark.parametrize("method", ["Imakura", "targetvec", "QR_SVD", "GEP", "GEP_weighted_maps"])
def test_summed_terms_against_dense_solves(spark, method):
    images = random_images(4, 60, 5, seed=7)
    s = list(images.values())
    if method == "Imakura":
        values, goal = None, la.left_singular(s, 3)
        maps = [np.linalg.pinv(x) @ goal for x in s]
    elif method in ("targetvec", "QR_SVD"):
        singular, maps, u = la.shared_basis(s, 3)
        values = 4 - singular**2 if method == "targetvec" else 2 * 4 - 2 * singular**2
        maps = [np.linalg.pinv(x) @ u for x in s] if method == "targetvec" else maps
    else:
        values, maps = la.block_eigen(s, 3)
        maps = [g * la.eigen_weights(values) for g in maps] if method == "GEP_weighted_maps" else maps
    shared, solution = ig.integrate(long_table(spark, images), 3, method)
    if values is not None:
        assert np.allclose(solution.values, values, atol=1e-8)
    got, rows = images_in(shared), images_in(shared, "train")
    sign = np.sign((got[0] * (s[0] @ maps[0])).sum(axis=0))
    for i, x in images.items():
        assert np.allclose(got[i] * sign, x @ maps[i], atol=1e-5), (method, i)
        assert np.allclose(rows[i] * sign, (1.5 * x[:3]) @ maps[i], atol=1e-5)


@pytest.mark.parametrize("method", ["nonlinear", "nonlinear_linear"])
def test_summed_smoothers_against_all_at_once(spark, method):
    images = random_images(3, 40, 4, seed=3)
    both = method == "nonlinear_linear"
    fits = {i: la.smoother(x, 0.25, 0.1, both) for i, x in images.items()}
    values, target = la.least_disagreement([f[0] for f in fits.values()], 3)
    shared, solution = ig.integrate(long_table(spark, images), 3, method)
    assert np.allclose(solution.values, values, atol=1e-10) and np.allclose(aligned(solution.target, target), target, atol=1e-6)
    for i, z in images_in(shared, "train").items():
        assert np.allclose(aligned(z, fits[i][1](target)(1.5 * images[i][:3])), fits[i][1](target)(1.5 * images[i][:3]), atol=1e-5)


def plain_search(images, p, start, penalty=1e-9):
    """The same search with every smoother factored anew for each loss."""
    half, logs = len(images[0]) // 2, {i: np.log(g) for i, g in start.items()}

    def loss(at):
        fits = {i: la.smoother(s[:half], float(np.exp(at[i])), penalty) for i, s in images.items()}
        _, z = la.least_disagreement([f[0] for f in fits.values()], p)
        held = [fits[i][1](z)(s[half:]) for i, s in images.items()]
        mean = sum(held) / len(held)
        return float(sum(((h - mean) ** 2).sum() for h in held) / max((mean**2).sum(), 1e-300))

    step, left, best = dict.fromkeys(images, np.log(10.0)), dict.fromkeys(sorted(images), 2), loss(logs)
    for _ in range(300):
        slopes = {i: loss({**logs, i: logs[i] + 1e-4}) - loss({**logs, i: logs[i] - 1e-4}) for i in left}
        for i, slope in slopes.items():
            for side in (-np.sign(slope), np.sign(slope)):
                moved = {**logs, i: logs[i] + side * step[i]}
                if (new := loss(moved)) < best:
                    logs, best = moved, new
                    break
            else:
                step[i] /= 2
                left[i] -= 1
                if not left[i]:
                    del left[i]
        if not left:
            break
    return {i: float(np.exp(v)) for i, v in logs.items()}


def test_widths_searched_by_sums(spark):
    # a penalty that keeps the smoothers well-conditioned, so that both ways round alike
    images, start = random_images(3, 30, 4, seed=11), {i: 0.25 for i in range(3)}
    plain = plain_search(images, 2, start, 1e-3)
    summed = ig.tuned_widths(images, 2, start, 1e-3)
    assert {i: round(np.log(g), 6) for i, g in plain.items()} == {i: round(np.log(g), 6) for i, g in summed.items()}
    how = ig.Method("nonlinear_tuning")
    object.__setattr__(how, "penalty", 1e-3)
    anchors, m, r = ig.anchor_rows(long_table(spark, images))
    assert (m, r) == (3, 30)
    assert {i: round(np.log(g), 6) for i, g in ig.tuned_widths_of(anchors, how, 2, m).items()} == {i: round(np.log(g), 6) for i, g in plain.items()}


def test_thousands_of_institutions(spark):
    m, r = 2500, 24
    rng = np.random.default_rng(0)
    base = rng.normal(size=(r, 3))
    images = {i: base @ rng.normal(size=(3, 2)) + 0.2 * rng.normal(size=(r, 2)) for i in range(m)}
    table = long_table(spark, images, extra=1)
    u, s, _ = np.linalg.svd(np.hstack([x @ np.linalg.inv(np.linalg.cholesky(x.T @ x + 1e-6 * np.eye(2))).T for x in images.values()]), full_matrices=False)
    shared, solution = ig.integrate(table, 2, "GEP")
    assert np.allclose(solution.values, 2 * m - 2 * s[:2] ** 2, rtol=1e-9) and not solution.linear
    assert np.allclose(aligned(solution.target, u[:, :2]), u[:, :2], atol=1e-6)
    assert shared.count() == m * (r + 2)
    with pytest.raises(ValueError, match="columns in all"):
        ig.images_of(long_table(spark, {i: np.ones((2, 9)) for i in range(2400)}, extra=0))


def test_equal_spans_and_odd_shapes(spark):
    images = related_images(3, 40, 4, seed=2)
    for method in ("Imakura", "targetvec", "QR_SVD", "GEP", "ODC"):
        shared, _ = ig.integrate(long_table(spark, images), 4, method)
        assert all(r["max"] < 1e-4 and r["least_cosine"] > 0.999 and r["rank"] == 4 for r in ig.agreement(shared).collect()), method
    wide = {0: np.hstack([images[0], np.zeros((40, 2))]), 1: images[1]}  # columns without weight, unequal widths
    shared, solution = ig.integrate(long_table(spark, wide), 9, "targetvec")
    assert np.allclose(solution.target[:, 4:], 0) and all(r["rank"] == 4 for r in ig.agreement(shared).collect())
    with pytest.raises(Exception, match="one width"):
        ig.integrate(long_table(spark, wide), 4, "ODC")[0].collect()
    with pytest.raises(ValueError, match="unknown integration"):
        ig.integrate(long_table(spark, images), 2, "nothing")
    with pytest.raises(ValueError, match="no anchors"):
        ig.integrate(long_table(spark, images).filter("part = 'train'"), 2, "GEP")


@pytest.mark.parametrize("name", ["Imakura", "GEP", "ODC"])
def test_wrong_maps_do_not_meet_the_sql(spark, monkeypatch, sf_small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_small}/embeddings.parquet'")
    found = con.execute(ORACLES[f"integrate_{name}_exact"])
    columns = [d[0] for d in found.description]
    expected = sorted(found.fetchall())
    rows = lambda: sorted(tuple(r[c] for c in columns) for r in QUERIES[f"integrate_{name}_exact"](spark, sf_small).collect())
    assert rows() == expected
    whole, width = ig.project, 64 if name == "ODC" else 10
    rng = np.random.default_rng(0)

    def damaged(change):
        def run(reduced, solution):
            images, _ = ig.images_of(reduced)
            good = {i: solution.map_of(i, s) for i, s in images.items()}
            solution.linear = change(good)
            return whole(reduced, solution)

        monkeypatch.setattr(ig, "project", run)
        return rows()

    assert damaged(lambda g: g) == expected
    assert damaged(lambda g: {i: 0 * v for i, v in g.items()}) != expected
    order = sorted(expected)[-1][0]
    assert damaged(lambda g: {i: g[(i + 1) % (order + 1)] for i in g}) != expected
    assert damaged(lambda g: {**g, order: rng.normal(size=(64, width))}) != expected
    assert damaged(lambda g: {i: np.repeat(v[:, :1], width, axis=1) for i, v in g.items()}) != expected


def test_only_open_images_are_sent(spark):
    rows = [(i, j, [float(i), float(j)]) for i in range(5) for j in (2, 0, 1)]
    got = ig.open_images(spark.createDataFrame(rows, "institution int, row_id long, features array<double>"), {3, 1}).collect()
    assert [(r["institution"], r["n"], r["image"]) for r in got] == [(i, 3, [i, 0.0, i, 1.0, i, 2.0]) for i in (1.0, 3.0)]
