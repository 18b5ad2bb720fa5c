"""Linear and logistic heads: gradients against differences, the best head, the held-out stop."""

import numpy as np
import pytest

from tessella.functions import linalg as la
from tessella.operators import anchors as an
from tessella.operators import heads, joint
from tessella.operators import integrate as ig
from tessella.operators import reduce as rd
from tessella.plans import experiment
from tessella.session import stable

RNG = np.random.default_rng(0)
IMAGES = {i: RNG.normal(size=(20, 4)) for i in range(3)}
ROWS = {i: (RNG.normal(size=(30, 4)), RNG.integers(0, 3, 30)) for i in range(3)}


def slope(f, x, at, h=1e-6):
    e = np.zeros_like(x)
    e[at] = h
    return (f(x + e) - f(x - e)) / (2 * h)


def test_linear_gradient_through_the_eliminated_head():
    sums = {i: (len(x), x.T @ x, x.T @ heads.targets(y, 3), float((heads.targets(y, 3) ** 2).sum())) for i, (x, y) in ROWS.items()}
    own, anchors = heads.LinearHead(sums), heads.Anchors(IMAGES, 2)
    maps = {i: RNG.normal(size=(4, 2)) for i in ROWS}
    z = np.vstack([ROWS[i][0] @ maps[i] for i in ROWS])
    y = np.vstack([heads.targets(ROWS[i][1], 3) for i in ROWS])
    head = np.linalg.solve(z.T @ z + np.eye(2), z.T @ y)
    value, gradients, found = own.loss_and_gradients(maps)
    assert np.allclose(found, head) and np.isclose(value, (((y - z @ head) ** 2).sum() + (head**2).sum()) / 90)
    whole = lambda g: own.loss_and_gradients({**maps, 1: g})[0]
    for at in ((0, 0), (3, 1)):
        assert np.isclose(slope(whole, maps[1], at), gradients[1][at], rtol=1e-4, atol=1e-7)
    u = RNG.normal(size=anchors.start.shape)
    some = RNG.normal(size=u.shape)
    f = lambda x: float((anchors.stacked(x) * some).sum())
    for at in ((0, 0), (11, 1), (5, 0)):
        assert np.isclose(slope(f, u, at), anchors.slope(u, some)[at], rtol=1e-4, atol=1e-7)


def test_logistic_sums_against_differences():
    x, y = ROWS[0]
    head, g = RNG.normal(size=(3, 3)), RNG.normal(size=(4, 2))
    loss, dh, curve, dg = heads.logistic_sums(head, g, x, y)
    for at in ((0, 0), (2, 1), (1, 2)):
        assert np.isclose(slope(lambda h: heads.logistic_sums(h, g, x, y)[0], head, at), dh[at], rtol=1e-4)
        column = slope(lambda h: heads.logistic_sums(h, g, x, y)[1], head, at)
        assert np.allclose(column.T.ravel(), curve[:, at[1] * 3 + at[0]], rtol=1e-4, atol=1e-5)
    for at in ((0, 0), (3, 1)):
        assert np.isclose(slope(lambda m: heads.logistic_sums(head, m, x, y)[0], g, at), dg[at], rtol=1e-4)


def test_quasi_newton_finds_a_minimum():
    a = np.diag([1.0, 10.0, 100.0, 1e3])
    x = heads.lbfgs(lambda x: (float(0.5 * x @ a @ x - x.sum()), a @ x - 1), np.ones(4), 200, tolerance=1e-16)
    assert np.allclose(x, 1 / np.diag(a), atol=1e-5)


@pytest.mark.parametrize("head", heads.HEADS)
def test_heads_learn_and_stop_by_training_rows(spark, sf_small, head):
    dealt, classes = experiment.split_rows(experiment.embeddings(spark, sf_small), experiment.Config())
    reduced = stable(rd.reduce_locally(dealt, an.make_anchors(spark, 60, 64, 0), "svd", 12))
    settings = {"rounds": 60} if head == "linear_objective" else {"rounds": 12, "newton": 6}
    solution, told = heads.head_maps(reduced, 8, classes, head, **settings)
    assert told["held_end"] < told["held_start"] and np.allclose(told["norms"], 1)
    assert set(solution.linear) == {r[0] for r in dealt.select("institution").distinct().collect()}
    if head == "linear_objective":
        assert told["end"] < told["start"]
    else:
        assert told["newton_slope"] < 1e-3 and told["log"][-1][0] < told["log"][6][0]
    without_test = reduced.filter("part <> 'test'")
    again, _ = heads.head_maps(without_test, 8, classes, head, **settings)
    assert all(np.allclose(again.linear[i], g, atol=1e-6) for i, g in solution.linear.items())  # test rows change nothing
    with pytest.raises(ValueError, match="unknown head"):
        heads.head_maps(reduced, 8, classes, "cubic")


def test_anchors_of_many_institutions_by_blocks():
    """15,000 columns in all: their square would take 1.8 GB."""
    from tessella.operators import joint

    rng = np.random.default_rng(0)
    some = {i: rng.normal(size=(30, 4 + i % 2)) for i in range(9)}
    (a, b, cuts), (whole, sizes, own) = joint.anchor_blocks(some), joint.anchor_matrices(some)
    v = rng.normal(size=(len(sizes), 3))
    assert cuts == own and np.allclose(a @ v, whole @ v) and np.allclose(b @ v, sizes @ v)
    (x, dx), (y, dy) = joint.anchor_loss(v, a, b, 0.7, 0.3), joint.anchor_loss(v, whole, sizes, 0.7, 0.3)
    assert np.isclose(x, y) and np.allclose(dx, dy)
    values, first = joint.leading(a, b.cholesky(), 3)
    expected, maps = la.block_eigen([some[i] for i in sorted(some)], 3)
    assert np.allclose(values, expected) and np.allclose(first, np.vstack(maps), atol=1e-6)
    many = heads.Anchors({i: rng.normal(size=(20, 12)) for i in range(1250)}, 4)
    assert np.allclose((many.stacked(many.start) * (many.b @ many.stacked(many.start))).sum(axis=0), 1)


def test_anchor_rows_do_not_come_to_the_driver(spark, monkeypatch):
    """Images of 40 anchors within 4 directions arrive as 4 rows each, and solve to the same as whole ones."""
    rng = np.random.default_rng(3)
    base, m, k = rng.normal(size=(40, 4)), 60, 3
    images = {i: base @ rng.normal(size=(4, k)) for i in range(m)}
    rows = [(i, "anchor", r, None, x.tolist(), float("nan")) for i, s in images.items() for r, x in enumerate(s)]
    rows += [(i, "train", r, int(x.sum() > 0), x.tolist(), float("nan")) for i in images for r, x in enumerate(rng.normal(size=(12, k)))]
    reduced = stable(spark.createDataFrame(rows, ig.SCHEMA).repartition(5))
    found, n = ig.coordinates_of(reduced)
    assert n == 40 and list(found) == sorted(images) and all(c.shape == (4, k) for c in found.values())
    assert all(np.allclose(found[i].T @ found[j], images[i].T @ images[j]) for i in (0, 7) for j in images)
    empty, n = ig.coordinates_of(reduced.withColumn("features", ig.F.transform("features", lambda x: x * 0)))
    assert n == 40 and all(c.shape == (1, k) and not c.any() for c in empty.values())
    runs = {"joint": lambda: joint.joint_maps(reduced, 2, 2, hidden=8, rounds=3)[0], "linear": lambda: heads.linear_maps(reduced, 2, 2, rounds=5)[0], "logistic": lambda: heads.logistic_maps(reduced, 2, 2, rounds=2, newton=2)[0]}
    sizes, plain = [], type(reduced).toPandas

    def told(self):
        out = plain(self)
        sizes.append(sum(np.size(x) for c in out.columns for x in out[c]))
        return out

    monkeypatch.setattr(type(reduced), "toPandas", told)
    maps = {name: run().linear for name, run in runs.items()}
    assert max(sizes) < 40 * k * m / 3, sizes
    for module in (joint, heads):
        monkeypatch.setattr(module, "coordinates_of", lambda _: (images, 40))
    for name, run in runs.items():
        assert all(np.allclose(maps[name][i], g, atol=1e-6) for i, g in run().linear.items()), name
