"""Boosted trees against a plain build, the settings' sampler against random search, pruning."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import boosting as bo


def table(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3)).round(2)
    y = np.where(x[:, 0] > 0.5, 3.0, 0.0) + 2 * x[:, 1] + 0.1 * rng.normal(size=n)
    return spark.createDataFrame([(i, float(v), [float(a) for a in r]) for i, (r, v) in enumerate(zip(x, y, strict=True))], "row_id long, y double, features array<double>").repartition(3), x, y


def plain_tree(bins, g, model):
    """The same tree, grown by recursion over the rows."""
    size = 2 ** (model.depth + 1) - 1
    feature, at, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)

    def grow(place, rows, level):
        total, n = g[rows].sum(), len(rows)
        value[place] = model.rate * total / (n + model.ridge)
        best = (1e-9 * max(abs(total), 1.0), None)
        for f in range(bins.shape[1]):
            for b in range(bo.BINS - 1):
                left = rows[bins[rows, f] <= b]
                if model.least_rows <= len(left) <= n - model.least_rows and level < model.depth:
                    rest = total - g[left].sum()
                    gain = g[left].sum() ** 2 / (len(left) + model.ridge) + rest**2 / (n - len(left) + model.ridge) - total**2 / (n + model.ridge)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, b))
        if best[1]:
            feature[place], at[place] = best[1]
            side = bins[rows, best[1][0]] > best[1][1]
            grow(2 * place + 1, rows[~side], level + 1)
            grow(2 * place + 2, rows[side], level + 1)

    grow(0, np.arange(len(g)), 0)
    return feature, at, value


def test_trees_against_a_plain_build(spark):
    rows, x, y = table(spark)
    boosting = bo.Boosting(rows, 3)
    models, outcome = boosting.train({0: {"rate": 0.3, "depth": 2, "ridge": 1.0, "least_rows": 5}, 1: {"rate": 0.5, "depth": 1, "ridge": 0.1, "least_rows": 20}}, 3, {})
    held = {r["row_id"]: r["fold"] for r in boosting.rows.collect()}
    fold = np.array([held[i] for i in range(len(y))])
    bins = np.stack([np.searchsorted(e, x[:, c], "left") for c, e in enumerate(boosting.edges)], axis=1)
    for trial in (0, 1):
        square = 0.0
        for m in [m for m in models if m.trial == trial]:
            own = fold != m.fold
            assert np.isclose(m.base, y[own].mean())
            score, best = np.full(len(y), m.base), outcome[trial]["best_round"]
            for tree in m.trees[:best]:
                want = plain_tree(bins[own], (y - score)[own], m)
                got = bo.predicted(bins, [tree])
                assert np.allclose(got, bo.predicted(bins, [want]), atol=1e-8)
                score = score + got
            square += ((y - score)[~own] ** 2).sum()
        assert np.isclose(outcome[trial]["rmse"], np.sqrt(square / len(y)), atol=1e-8) or outcome[trial]["pruned"]


def test_equal_bins_are_trained_as_one_group(spark):
    """Rounds go over groups of equal bins, each row counted: ten times the rows are the same groups, and the trees of ten times the rows."""
    rows, _, _ = table(spark, 300, 2)
    rows = rows.withColumn("features", F.transform("features", lambda v: F.floor(v * 3).cast("double")))
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9)))).drop("copy")
    one, ten = bo.Boosting(rows, 3), bo.Boosting(many, 3)
    assert one.groups.count() <= 27 * bo.FOLDS and ten.groups.count() == one.groups.count() and ten.groups.agg(F.sum("n")).first()[0] == 3000
    trained = [b.train({0: {"rate": 0.3, "depth": 2, "ridge": 1e-9, "least_rows": 1}}, 2, {}) for b in (one, ten)]
    assert np.isclose(trained[0][1][0]["rmse"], trained[1][1][0]["rmse"])


def test_sampler_beats_random_search():
    goal = np.array([0.2, 0.7, 0.45, 0.9])
    f = lambda x: float(((x - goal) ** 2).sum())
    ours, chance = [], []
    for seed in range(20):
        s = bo.Sampler(4, seed)
        for _ in range(50):
            p = s.ask()
            assert ((p >= 0) & (p <= 1)).all()
            s.tell(p, f(p))
        ours.append(min(s.scores))
        chance.append(min(f(p) for p in np.random.default_rng(1000 + seed).random((50, 4))))
    assert np.mean(ours) < 0.6 * np.mean(chance)


def test_search_prunes_and_predicts(spark):
    rows, x, y = table(spark, 500, 4)
    boosting, models, trials = bo.tuned(rows.filter("row_id % 4 > 0"), 2, 3, 5)
    assert len(trials) == 6 and any(t["pruned"] for t in trials) and len(models) == bo.FOLDS
    assert trials[models[0].trial]["rmse"] == min(t["rmse"] for t in trials)
    assert all(0.02 <= t["rate"] <= 0.6 and t["depth"] in (1, 2, 3) for t in trials)
    test = rows.filter("row_id % 4 = 0").withColumn("more", F.lit("kept"))
    got = boosting.predict(test, models).collect()
    errors = np.array([r["y"] - r["prediction"] for r in got])
    assert len(got) == 125 and got[0]["more"] == "kept" and (errors**2).mean() < 0.5 * y.var()
