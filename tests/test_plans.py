import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import expressions as fx
from tessella.operators import metrics, prep, split
from tessella.operators import reduce as rd
from tessella.plans import experiment, grid, results
from tessella.sources import loaders, sinks, synthetic


def test_split_covers_every_class(spark):
    rows = spark.range(200).withColumn("target", (F.col("id") % 4).cast("int"))
    for parts in (1, 7):
        dealt = split.covering_split(rows.repartition(parts), "target", 4, 12, [F.xxhash64("id"), F.col("id")]).cache()
        got = split.class_coverage(dealt, "target").collect()
        assert len(got) == 8 and all(r["n_rows"] == 12 and r["complete"] for r in got)
        assert dealt.select("id").distinct().count() == 96
        ids = sorted(map(tuple, dealt.select("id", "split", "institution").collect()))
        assert parts == 1 or ids == last
        last = ids
    assert split.covering_split(rows, "target", 4, 4, [F.col("id")]).count() == 32  # nothing left to fill


@pytest.mark.parametrize(("m", "u", "text"), [(10, 50, "asked for"), (2, 3, "cannot hold"), (26, 3, "cannot hold")])
def test_split_refuses(spark, m, u, text):
    rows = spark.range(200).withColumn("target", (F.col("id") % 4).cast("int"))
    with pytest.raises(ValueError, match=text):
        split.check_shape(rows, "target", m, u)
    rare = rows.withColumn("target", F.when(F.col("id") < 3, 9).otherwise(F.col("target")))
    with pytest.raises(ValueError, match="fewer than two"):
        split.check_shape(rare, "target", 2, 20)


def test_shape_defaults():
    assert vars(split.resolve_shape(500, 44, 64)) == {"institutions": 5, "rows": 50, "features": 64, "dim_local": 63, "dim_shared": 63}
    assert split.resolve_shape(10, 3, 64, dim_local=0, rows=-1).institutions == 1


def test_number_text(spark):
    values = [None, 1.0, 0.1, 1e-8, 2.5, 123456.5, 1234567.25, 0.000125, -3.75, 1e20 + 0.0]
    expected = ["NA"] + [str(int(v)) if float(v).is_integer() else f"{v:g}" for v in values[1:-1]]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values[:-1])], "i int, v double").orderBy("i").select(fx.number_text(F.col("v"))).collect()]
    assert got[:5] == expected[:5] and got[6:] == expected[6:]


def test_auc_ties_and_single_class(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("b", 1, 0.1)], "k string, y int, s double")
    got = {r["k"]: r["auc"] for r in metrics.auc_binary(rows, "y", "s", ["k"]).collect()}
    assert got == {"a": 0.75, "b": None}
    assert metrics.auc_binary(rows.limit(0), "y", "s").first()["auc"] is None


def test_null_keys_match_and_first_wins(spark):
    base = "row_id long, dataset string, h_model string, F_type string, gamma_type string, num_institution_user int, G_type string, score_mean double, odd_mean double, even_mean double"
    rows = spark.createDataFrame([(1, "d", "h", "f", None, 5, "individual", 0.5, 0.5, 0.5), (2, "d", "h", "f", None, 5, "individual", 0.9, 0.9, 0.9), (3, "d", "h", "f", None, 5, "nonlinear", 0.6, 0.6, 0.6), (4, "e", "h", "f", None, 5, "nonlinear", 0.9, 0.9, 0.9)], base)
    assert [r["row_id"] for r in results.beat_individual(rows, results.individual_reference(rows)).collect()] == [3]
    best = results.best_per_group(spark.createDataFrame([("g", 2, 1.0), ("g", 1, 1.0), ("h", 3, None)], "k string, row_id long, score_mean double"), ["k"]).collect()
    assert [(r["k"], r["row_id"]) for r in best] == [("g", 1)]


def test_rules_lock_then_skip_and_empty_lists(spark):
    combos = grid.product(spark, {"G_type": ["GEP", "nonlinear"], "nl": [0.1, 1.0]})
    got = grid.apply_rules(combos, [grid.Rule({"G_type": ["GEP"]}, {"nl": 0.1}), grid.Rule({"nl": [1.0]})])
    assert sorted(map(tuple, got.collect())) == [("GEP", 0.1), ("nonlinear", 0.1)]
    with pytest.raises(ValueError, match="no values"):
        grid.product(spark, {"a": []})


def test_imputation_takes_near_rows(spark):
    rows = [(i, float(i // 10), float(i // 10) * 100) for i in range(40)] + [(100, 2.0, None), (101, None, None)]
    got = {r["k"]: r["b"] for r in prep.knn_impute(spark.createDataFrame(rows, "k long, a double, b double"), "k", ["a", "b"]).collect()}
    assert got[100] == 200.0 and got[101] == 150.0 and got[5] == 0.0


def test_zero_deviation_and_ranges(spark):
    rows = spark.createDataFrame([(1.0, float("nan")), (1.0, float("inf"))], "a double, b double")
    assert [r["a"] for r in prep.standardise(rows, ["a"]).collect()] == [0.0, 0.0]
    assert {r["feature"]: (r["low"], r["high"]) for r in prep.feature_ranges(rows, ["a", "b"]).collect()} == {"a": (1.0, 1.0), "b": (-1.0, 1.0)}


def test_loaders(spark, tmp_path):
    (tmp_path / "q.csv").write_text(";".join(["1"] * 41 + ["RB"]) + "\n" + ";".join(["x"] + ["2"] * 40 + ["NRB"]) + "\n" + ";".join(["3"] * 41 + ["?"]) + "\n")
    got = loaders.load(spark, "qsar", str(tmp_path / "q.csv")).orderBy("feature_1").collect()
    assert [r["target"] for r in got] == [1, 0, None] and got[1]["feature_0"] is None
    (tmp_path / "s.txt").write_text("  1   2\t3 4 5 6 7  1\n8 7 6 5 4 3 2 3\n\n")
    assert sorted(r["target"] for r in loaders.load(spark, "seeds", str(tmp_path / "s.txt")).collect()) == [1.0, 3.0]
    for kind, q in (("red", "5"), ("white", "8")):
        (tmp_path / f"winequality-{kind}.csv").write_text('"acid";"quality"\n' + f"1.5;{q}\n" * 12)
    wine = loaders.load(spark, "wine_quality", str(tmp_path))
    assert {(r["wine_type"], r["target"]) for r in wine.collect()} == {("red", "low"), ("white", "high")}
    (tmp_path / "a.csv").write_text("39, State-gov, 77516, Bachelors, 13, Never, ?, Not, White, Male, 0, 0, 40, US, <=50K\n")
    adult = loaders.load(spark, "adult", str(tmp_path / "a.csv")).first()
    assert adult["age"] == 39.0 and adult["occupation"] is None and adult["target"] == "<=50K"
    for side in ("train", "test"):
        (tmp_path / side).mkdir()
        for kind, text in (("subject", "1\n2\n"), ("y", "5\n6\n"), ("X", "0.5 0.25\n1.5 1.25\n")):
            (tmp_path / side / f"{kind}_{side}.txt").write_text(text)
    (tmp_path / "features.txt").write_text("1 mean\n2 mean\n")
    har = loaders.load(spark, "har", str(tmp_path))
    assert har.columns == ["subject", "target", "mean", "mean.1"] and sorted((r["subject"], r["target"], r["mean.1"]) for r in har.collect()) == [("1", "5", 0.25)] * 2 + [("2", "6", 1.25)] * 2
    with pytest.raises(ValueError, match="unknown"):
        loaders.load(spark, "nothing", "")
    assert loaders.first_path(spark, [str(tmp_path / "no"), str(tmp_path / "q.csv")]).endswith("q.csv")
    (tmp_path / "j.csv").write_bytes("name,y\nテスト,1\n".encode("cp932"))
    assert loaders.read_csv(spark, str(tmp_path / "j.csv"), header=True, encodings=("UTF-8", "windows-31j")).first()["name"] == "テスト"


def test_sinks_widen_and_time(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_log(spark.createDataFrame([(1,)], "a int"), path)
    sinks.append_log(spark.createDataFrame([(2, "x")], "a int, b string"), path)
    assert sorted((r["a"], r["b"]) for r in sinks.read_log(spark, path).collect()) == [(1, None), (2, "x")]
    assert sinks.timed(lambda: 7, str(tmp_path / "t"), spark, run="r") == 7
    assert sinks.read_log(spark, str(tmp_path / "t")).columns == ["func", "elapsed_ms", "run"]


def test_synthetic_tables(spark):
    got = synthetic.two_gaussians(spark, 400, 5.0).groupBy("target").agg(F.avg("x1").alias("m")).collect()
    assert {r["target"]: round(r["m"]) for r in got} == {0: 0, 1: 5}
    radius = synthetic.rings(spark, 300, (1.0, 4.0), 0.05).groupBy("target").agg(F.avg(F.sqrt(F.col("x1") ** 2 + F.col("x2") ** 2)).alias("r")).collect()
    assert {r["target"]: round(r["r"]) for r in radius} == {0: 1, 1: 4}
    assert synthetic.cube_gaussians(spark, 80).select("target").distinct().count() == 8
    c = synthetic.slanted_gaussians(spark, 3000).filter("target = 0").agg(F.corr("x1", "x2")).first()[0]
    assert math.isclose(c, 0.8, abs_tol=0.06)


def test_collaboration_beats_chance_and_sees_no_rows_in_the_solve(spark):
    rows = synthetic.gaussians(spark, 600, [(0.0,) * 6, (2.0,) * 6, (0.0, 2.0) * 3], 1.0).select(F.monotonically_increasing_id().alias("row_id"), "target", F.array(*[f"x{i}" for i in range(1, 7)]).alias("features"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = experiment.run_once(rows, experiment.Config(dim_intermediate=5, num_institution=3, num_institution_user=40, num_anchor_data=80)).collect()
    assert len(got) == 3 and all(r["n_test"] == 40 and r["score"] > 0.85 for r in got)
    with pytest.raises(ValueError, match="unknown reduction"):
        rd.reduce_locally(rows, rows, "nothing", 2)


def test_exported_tables_and_published_names(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b,MedHouseVal\n1,2,3.5\n4,x,1\n")
    rows = loaders.load(spark, "housing", [str(tmp_path / "none.csv"), str(tmp_path / "h.csv")]).orderBy("a").collect()
    assert [r["target"] for r in rows] == ["3.5", "1"] and rows[1]["b"] is None
    spark.createDataFrame([("CCO", 1)], "Drug string, Y int").write.parquet(str(tmp_path / "t.parquet"))
    assert loaders.load(spark, "ames", str(tmp_path / "t.parquet")).first().asDict() == {"Drug": "CCO", "target": 1}
    assert len(loaders.LOADERS) == 30 and "asymmetry_coefficient" in loaders.SEEDS


def test_network_machines_and_own_reductions(spark, sf_small):
    from tessella.operators import models

    rows = experiment.embeddings(spark, sf_small)
    plain = rows.withColumn("side", F.pmod(F.xxhash64("row_id"), F.lit(3)))
    train, test = plain.filter("side > 0").drop("side"), plain.filter("side = 0").drop("side")
    for model in ("mlp", "svm_linear"):
        scored = models.fit_and_score(train, test, model, 4).collect()
        assert all(abs(sum(r["scores"]) - 1) < 1e-6 for r in scored)
        assert sum(r["predicted"] == r["target"] for r in scored) > 0.6 * len(scored), model
    own = experiment.run_once(rows, experiment.Config(G_type="individual_dim", dim_intermediate=20)).collect()
    assert len(own) == 5 and all(0 <= r["score"] <= 1 for r in own)
    best = experiment.best_ratios(rows, experiment.Config(F_type="kernel_pca_self_tuning", dim_intermediate=10), (0.1, 1.0)).collect()
    assert len(best) == 5 and all(r["best_param"] in (0.1, 1.0) for r in best)


def test_moments_far_from_zero_and_medians_in_blocks(spark, monkeypatch):
    import numpy as np

    from tessella.operators import pairs

    x = 1e9 + np.random.default_rng(3).normal(size=500)
    got = metrics.moments(spark.createDataFrame([(i % 7, float(v)) for i, v in enumerate(x)], "i int, x double"), F.col("i"), ["x"]).first()
    assert abs(got["var"] - x.var()) < 1e-4 and abs(got["mean"] - x.mean()) < 1e-5
    rows = spark.createDataFrame([(i, [float(v) for v in np.random.default_rng(i).normal(size=4)]) for i in range(90)], "k long, v array<double>")
    y = np.array([r["v"] for r in rows.collect()])
    monkeypatch.setattr(pairs, "BLOCK", 25)
    monkeypatch.setattr(pairs, "BINS", 8)
    q = np.sort([((a - b) ** 2).sum() for i, a in enumerate(y) for b in y[i + 1 :]])
    got = pairs.median_gammas(rows, "k", "v").first()
    assert got["n_pairs"] == len(q) and abs(got["gamma_median_of_squares"] - 1 / np.median(q)) < 1e-9 and abs(got["gamma_half_median_squared"] - 1 / (2 * np.median(np.sqrt(q)) ** 2)) < 1e-9


def test_joint_training_of_maps_and_network(spark, sf_small):
    from tessella.operators import anchors as an
    from tessella.operators import joint
    from tessella.session import stable

    dealt, classes = experiment.split_rows(experiment.embeddings(spark, sf_small), experiment.Config())
    reduced = stable(rd.reduce_locally(dealt, an.make_anchors(spark, 60, 64, 0), "svd", 8))
    maps, losses = joint.joint_maps(reduced, 6, classes, hidden=32, rounds=15, rate=1e-2)
    assert len(losses) > 1 and losses[-1] < losses[0]
    images, _ = joint.images_of(reduced)
    _, b, cuts = joint.anchor_matrices(images)
    v = np.vstack([maps.linear[i] for i in sorted(cuts)])
    assert np.allclose((v * (b @ v)).sum(axis=0), 1)
    only_anchors, kept = joint.joint_maps(reduced, 6, classes, weight_pred=0.0, hidden=8, rounds=5)
    assert np.isclose(kept[0], only_anchors.values.sum(), rtol=1e-4)  # it starts from the generalised eigenvectors


def test_joint_training_goes_through_all_rounds_unless_the_loss_stands_still(spark, monkeypatch):
    from tessella import method_queries
    from tessella.operators import joint
    from tessella.session import stable

    seen = []
    monkeypatch.setattr(experiment, "run_once", lambda rows, config: seen.append(config) or rows)
    method_queries.QUERIES["collaboration_joint"](spark, "/root/testdata/sf0.001")
    assert seen[0].joint_rounds == experiment.Config().joint_rounds == joint.ROUNDS == 1000
    monkeypatch.setattr(joint, "LOOK", 4)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 3))
    rows = [(i, "anchor", r, None, x.tolist(), float("nan")) for i in range(2) for r, x in enumerate(base @ rng.normal(size=(3, 3)))]
    rows += [(i, "train", r, int(x[0] > 0), x.tolist(), float("nan")) for i in range(2) for r, x in enumerate(rng.normal(size=(12, 3)))]
    reduced = stable(spark.createDataFrame(rows, rd.SCHEMA))
    run = lambda **more: len(joint.joint_maps(reduced, 2, 2, hidden=8, rounds=11, **more)[1])
    assert run(tolerance=1e-12) == 11 and run(tolerance=10.0) == 5 and run(tolerance=10.0, weight_pred=0.0) == 5


def test_joint_gradients_against_differences():
    from tessella.operators import joint
    from tessella.operators.federated import start

    rng = np.random.default_rng(0)
    images = {i: rng.normal(size=(20, 4)) for i in range(3)}
    a, b, cuts = joint.anchor_matrices(images, 0.0)
    v = rng.normal(size=(12, 2))
    pairs = sum(((images[i] @ v[cuts[i]] - images[j] @ v[cuts[j]]) ** 2).sum() for i in range(3) for j in range(3))
    value, grad = joint.anchor_loss(v, a, b, 1.0, 0.0)
    assert np.isclose(value, pairs)
    value, grad = joint.anchor_loss(v, a, b, 0.7, 0.3)
    step = np.zeros_like(v)
    step[5, 1] = 1e-6
    assert np.isclose((joint.anchor_loss(v + step, a, b, 0.7, 0.3)[0] - joint.anchor_loss(v - step, a, b, 0.7, 0.3)[0]) / 2e-6, grad[5, 1], rtol=1e-4)
    shape, x, y, g = (2, 5, 3), rng.normal(size=(9, 4)), rng.integers(0, 3, 9), rng.normal(size=(4, 2))
    flat = start(*shape, 1)
    loss, dn, dg = joint.row_gradients(flat, g, x, y, shape)
    for at in (0, 7, len(flat) - 1):
        e = np.eye(len(flat))[at] * 1e-6
        assert np.isclose((joint.row_gradients(flat + e, g, x, y, shape)[0] - joint.row_gradients(flat - e, g, x, y, shape)[0]) / 2e-6, dn[at], rtol=1e-4, atol=1e-6)
    e = np.zeros_like(g)
    e[2, 1] = 1e-6
    assert np.isclose((joint.row_gradients(flat, g + e, x, y, shape)[0] - joint.row_gradients(flat, g - e, x, y, shape)[0]) / 2e-6, dg[2, 1], rtol=1e-4)


def test_pooled_reductions_are_those_of_one_institution(spark, sf_small):
    rows = experiment.embeddings(spark, sf_small).limit(150).withColumn("part", F.when(F.col("row_id") % 3 == 0, "test").otherwise("train"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    none = spark.createDataFrame([("anchor", 0, [0.0] * 64), ("anchor_test", 0, [0.0] * 64)], "anchor_set string, anchor_id long, features array<double>")
    for method in ("svd", "kernel_pca", "kernel_pca_self_tuning", "cca", "samespan", "samespan_orth"):
        one = {r["row_id"]: r["features"] for r in rd.reduce_locally(rows.withColumnRenamed("part", "split").withColumn("institution", F.lit(0)), none, method, 5).filter("part IN ('train', 'test')").collect()}
        for parts in (1, 6):
            pooled = rd.reduce_pooled(rows.repartition(parts), method, 5)
            assert pooled.columns == rows.columns
            got = {r["row_id"]: r["features"] for r in pooled.collect()}
            x, y = (np.array([d[i] for i in sorted(one)]) for d in (got, one))
            assert len(got) == 150 and np.allclose(x * np.sign((x * y).sum(axis=0)), y, atol=1e-5), method
    from tessella.functions import linalg as la
    from tessella.operators.pairs import bounded_draw

    table = sorted((r["row_id"], r["part"], r["features"]) for r in rows.collect())
    x = np.array([t[2] for t in table])
    train = np.array([t[1] == "train" for t in table])
    points = np.array([r["features"] for r in bounded_draw(rows.filter("part = 'train'"), "row_id", 40).collect()])
    scale = lambda z: (z - x[train].mean(axis=0)) / x[train].std(axis=0)
    w, u = np.linalg.eigh(la.rbf(scale(points), scale(points), 1 / 64))
    lifted = la.rbf(scale(x), scale(points), 1 / 64) @ (u / np.sqrt(w)) @ u.T
    centred = lifted - lifted[train].mean(axis=0)
    expected = centred @ np.linalg.svd(centred[train], full_matrices=False)[2][:3].T
    few = np.array([r["features"] for r in sorted(rd.reduce_pooled(rows, "kernel_pca", 3, landmarks=40).collect(), key=lambda r: r["row_id"])])
    assert np.allclose(few * np.sign((few * expected).sum(axis=0)), expected, atol=1e-6)
    with pytest.raises(ValueError, match="pooled form"):
        rd.reduce_pooled(rows, "lpp", 3)
    with pytest.raises(ValueError, match="no training rows"):
        rd.reduce_pooled(rows.filter("part = 'none'"), "svd", 3)


def test_lines_are_numbered_over_splits_of_files(spark, tmp_path):
    for name, first in (("b", 5000), ("a", 0)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{first + i} {'x' * (i % 40)}\n" + ("\n" if i % 7 == 0 else "") for i in range(900)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        frame = loaders.read_blank_separated(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], ["n", "x"])
        assert frame.rdd.getNumPartitions() > 8
        placed = {r["__line"]: int(r["n"]) for r in loaders.numbered_lines(frame).collect()}
        assert placed == {i: i if i < 900 else 5000 + i - 900 for i in range(1800)}
        short = loaders.read_blank_separated(spark, str(tmp_path / "a.txt"), ["m"])
        both = loaders.side_by_side(spark, loaders.numbers(frame, ["n"]), short).collect()
        assert len(both) == 1800 and all(r["m"] is None or float(r["m"]) == r["n"] for r in both) and sum(r["m"] is not None for r in both) == 900
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_inversion_and_leading_singular_value(spark, sf_small):
    from tessella.functions import linalg as la
    from tessella.operators import anchors as an

    dealt, _ = experiment.split_rows(experiment.embeddings(spark, sf_small), experiment.Config())
    anchors = an.make_anchors(spark, 80, 64, 3)
    reduced = rd.reduce_locally(dealt, anchors, "samespan", 10)
    plain = rd.anchor_matrices(anchors)["anchor"][1]
    rows = reduced.filter("institution = 1").toPandas().sort_values("row_id")
    image, test = (rd.matrix(rows[rows["part"] == part]["features"]) for part in ("anchor", "test"))
    got = np.array([r["guess"] for r in rd.inverted(reduced, anchors).filter("institution = 1").orderBy("row_id").collect()])
    assert np.allclose(got, la.linear_inversion(image, plain, test))
    x = np.array([r["features"] for r in dealt.collect()])
    assert abs(rd.top_singular_value(dealt) - np.linalg.norm(x, 2)) < 1e-6


def test_a_grid_goes_on_where_its_log_stops(spark, sf_small, tmp_path, monkeypatch):
    rows, log = experiment.embeddings(spark, sf_small), str(tmp_path / "grid")
    combos = grid.product(spark, {"G_type": ["Imakura", "unknown"]})
    base = experiment.Config(dim_intermediate=10, num_anchor_data=60)
    first = sorted(map(tuple, experiment.run_grid(rows, combos, [0], base, log).select("G_type", "status", "score").collect()))
    assert [r[1] for r in first] == ["ok", "failed"] and sinks.read_log(spark, log).count() == 2
    ran, whole = [], experiment.run_once
    monkeypatch.setattr(experiment, "run_once", lambda r, c: ran.append((c.G_type, c.run_seed)) or whole(r, c))
    again = experiment.run_grid(rows, combos, [0, 1], base, log, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    assert sorted(ran) == [("Imakura", 1), ("unknown", 0), ("unknown", 1)]  # what ended well is not run again
    assert sorted(map(tuple, again.filter("run_seed = 0").select("G_type", "status", "score").collect())) == first and again.count() == 4


def test_benchmark_over_classifiers(spark, sf_small):
    got = experiment.reduction_benchmark(experiment.embeddings(spark, sf_small), [60], [4], ["svd", "cca"], classifiers=("softmax", "random_forest")).collect()
    assert {(r["method"], r["clf"]) for r in got} == {(m, c) for m in ("svd", "cca") for c in ("softmax", "random_forest")}
    assert all(0 <= r["auc"] <= 1 and (r["method"] != "svd" or r["delta_vs_pca"] == 0) for r in got)
