"""Registered queries of the matrix and model operators. All of them work on the table of embeddings, dealt to as many institutions as its size allows.

Where a result does not depend on the basis that an eigensolver happens to return (sums of squares, traces), the query has a SQL
twin. Other results have none and are held against numpy by the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import linalg as la
from .operators import anchors as an
from .operators import collaborative, heads
from .operators import integrate as ig
from .operators import models as mo
from .operators import pairs
from .operators import reduce as rd
from .operators import split as sp
from .plans import experiment as ex
from .plans import grid
from .queries import ORACLES, ORDER_SQL, QUERIES, SHAPE_SQL, USERS, institutions, query, rounded
from .session import stable, table

def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("vec_id").alias("row_id"), F.col("label").alias("target"), F.col("embedding").cast("array<double>").alias("features"))
    return sp.covering_split(rows, "target", institutions(rows, "target"), USERS, [F.expr(ORDER_SQL), F.col("vec_id")])


def no_anchors(spark: SparkSession) -> DataFrame:
    return an.make_anchors(spark, 2, 64, 0)


TRAIN_SQL = f"WITH s AS ({ORACLES['institution_split']}), t AS (SELECT institution, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM s JOIN embeddings USING (vec_id) WHERE split = 'train')"


@query(TRAIN_SQL + ", v AS (SELECT institution, vec_id, unnest(e) AS x, unnest(range(64)) AS i FROM t) SELECT institution, round(sum(q), 6) AS sum_of_squares FROM (SELECT institution, i, var_pop(x) * count(*) AS q FROM v GROUP BY 1, 2) GROUP BY 1")
def reduce_svd_full_rank(spark, d):
    """With all components kept, a reduction keeps the rows' spread: a check that needs no basis."""
    reduced = rd.reduce_locally(dealt(spark, d), no_anchors(spark), "svd", 64)
    square = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)
    return rounded(reduced.filter("part = 'train'").groupBy("institution").agg(F.sum(square).alias("sum_of_squares")), "sum_of_squares")


@query(TRAIN_SQL + """, m AS (SELECT institution, i, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT institution, unnest(e) AS x, unnest(range(64)) AS i FROM t) GROUP BY 1, 2), l AS (SELECT institution, list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM m GROUP BY 1),
 z AS (SELECT institution, vec_id, list_transform(range(1, 65), lambda i: (e[i] - m[i]) / s[i]) AS e FROM t JOIN l USING (institution)),
 k AS (SELECT a.institution, exp(-list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 64) AS k FROM z a JOIN z b USING (institution))
 SELECT institution, round(sqrt(count(*)) - sum(k) / sqrt(count(*)), 5) AS trace FROM k GROUP BY 1""")
def reduce_kernel_pca_trace(spark, d):
    """All components of a kernel reduction add up to the trace of the centred kernel."""
    reduced = rd.reduce_locally(dealt(spark, d), no_anchors(spark), "kernel_pca", USERS)
    square = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)
    return rounded(reduced.filter("part = 'train'").groupBy("institution").agg(F.sum(square).alias("trace")), "trace", digits=5)


@query(TRAIN_SQL.replace("WHERE split = 'train'", "") + " SELECT institution, count(*) AS n, round(sum(list_sum(list_transform(e, lambda x: x * x))), 6) AS sum_of_squares FROM t GROUP BY 1")
def integrate_odc_keeps_lengths(spark, d):
    """Procrustes maps between images of full width are rotations."""
    rows = dealt(spark, d)
    anchors = an.make_anchors(spark, 200, 64, 1)
    reduced = stable(rd.reduce_locally(rows, anchors, "samespan_orth", 64))
    shared, _ = ig.integrate(reduced, 64, "ODC")
    square = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)
    return rounded(shared.filter("part IN ('train', 'test')").groupBy("institution").agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("sum_of_squares")), "sum_of_squares")


def _images(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        reduced = rd.reduce_locally(dealt(spark, d), an.make_anchors(spark, 100, 64, 2), method, 12)
        return reduced.select("institution", "part", "row_id", "target", "features", F.when(~F.isnan("gamma"), F.col("gamma")).alias("gamma"))

    run.__name__ = f"reduce_{method}"
    return run


for _m in rd.METHODS:
    QUERIES[f"reduce_{_m}"] = _images(_m)


#: (rank, centred, orthogonal, affine) of each reduction's images, as SQL; i is the institution. Very wide or narrow kernels are nearly affine: not told.
IDENTITIES = {"svd": ("12", "true", "true", "true"), "diffspan": ("12", "true", "false", "true"), "samespan_orth": ("12", "false", "false", "true"), "samespan": ("12", "false", "false", "true"),
              "lpp": ("12", "false", "false", "true"), "cca": ("9", "true", "true", "true"), "kernel_pca": ("12", "true", "true", "false"), "kernel_pca_self_tuning": ("12", "true", "true", "false"),
              "kernel_pca_unfixed_gamma": ("12", "true", "true", None), "kernel_pca_random_gamma": ("12", "true", "true", "false"), "kernel_pca_svd_mixed": ("12", "true", "true", "i % 2 = 1"),
              "kernel_pca_unfixed_mixed": ("12", "true", "true", None)}


def _kept(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = stable(dealt(spark, d))
        anchors = an.make_anchors(spark, 100, 64, 2, "uniform", an.ranges_of(rows.filter("split = 'train'")))  # near the rows, where kernels are not flat
        found = rd.identities(rd.reduce_locally(rows, anchors, method, 12), anchors)
        return found if affine else found.drop("affine")

    rank, centred, orthogonal, affine = IDENTITIES[method]
    run.__name__ = f"reduce_{method}_identities"
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = f"WITH k AS ({SHAPE_SQL}), r AS (SELECT unnest(range(m))::INT AS i FROM k) SELECT i AS institution, {USERS}::BIGINT AS n_train, {USERS}::BIGINT AS n_test, 100::BIGINT AS n_anchor, {rank}::INT AS rank, {centred} AS centred, {orthogonal} AS orthogonal" + (f", {affine} AS affine FROM r" if affine else " FROM r")


for _m in IDENTITIES:
    _kept(_m)


def _aligned(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        reduced = stable(rd.reduce_locally(dealt(spark, d), an.make_anchors(spark, 100, 64, 2), "svd", 12))
        shared, _ = ig.integrate(reduced, 10, method)
        # the test anchors tell how well the maps agree on rows they were not fitted on
        images = shared.filter("part = 'anchor_test'").select("institution", F.col("row_id").alias("anchor_id"), "features")
        return rounded(pairs.alignment_pairs(stable(images)), "sum", "mean", "max")

    run.__name__ = f"integrate_{method}"
    return run


for _m in ig.METHODS:
    QUERIES[f"integrate_{_m}"] = _aligned(_m)


INSTITUTIONS_SQL = f"WITH k AS ({SHAPE_SQL}), r AS (SELECT unnest(range(m))::INT AS i FROM k)"


def _exact(method: str, reduction: str):
    """Images of full width span the anchors' own space: linear maps bring them together without a rest, test anchors included. A row an institution.

    Its integrated anchors have full rank and orthogonal columns, equal to the first institution's, of a size that the method fixes: unit columns where
    the target itself is met, columns of length 1 over the root of the number of institutions where all images together have length one; Procrustes maps keep each image's own size.
    """
    width = 64 if method == "ODC" else 10

    def run(spark: SparkSession, d: str) -> DataFrame:
        reduced = stable(rd.reduce_locally(dealt(spark, d), an.make_anchors(spark, 200, 64, 2), reduction, 64))
        shared, solution = ig.integrate(reduced, width, method)
        if method == "GEP_weighted_maps":  # equal eigenvalues get weights by their rounding alone: take them out again
            back = F.lit([float(1 / w) for w in la.np.resize(la.eigen_weights(solution.values), width)])
            shared = shared.withColumn("features", F.zip_with("features", back, lambda x, w: x * w))
        found = ig.agreement(shared)
        if method == "ODC":
            square = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)
            sizes = reduced.filter("part = 'anchor'").groupBy("institution").agg(F.sum(square).alias("before"))
            found = found.join(sizes, "institution").withColumn("size", F.col("size") / F.col("before")).drop("before", "most_cross")
        return rounded(found, "size", "least_cosine", "most_cross", "mean", "max", digits=3)

    name = f"integrate_{method}_exact"
    run.__name__ = name
    QUERIES[name] = run
    size = {"Imakura": "10.0", "targetvec": "10.0", "ODC": "1.0"}.get(method, "10.0 / m")
    ORACLES[name] = f"WITH k AS ({SHAPE_SQL}) SELECT unnest(range(m))::INT AS institution, {width}::INT AS rank, round({size}, 3)::DOUBLE AS size, 1.0::DOUBLE AS least_cosine, " + ("" if method == "ODC" else "0.0::DOUBLE AS most_cross, ") + "0.0::DOUBLE AS mean, 0.0::DOUBLE AS max FROM k"


for _m in ("Imakura", "targetvec", "QR_SVD", "GEP", "GEP_weighted", "GEP_weighted_maps", "ODC"):
    _exact(_m, "samespan_orth")


@query()
def alignment_comparison(spark, d):
    """What linear and kernel maps leave of their best target, on images of anchors within the data's bounds under a linear and a kernel reduction."""
    rows, found = stable(dealt(spark, d)), []
    anchors = an.make_anchors(spark, 100, 64, 2, "uniform", an.ranges_of(rows.filter("split = 'train'")))
    for method in ("svd", "kernel_pca"):
        images, _ = ig.images_of(rd.reduce_locally(rows, anchors, method, 12).filter("part = 'anchor'"))
        linear, kernel = la.alignment_errors([images[i] for i in sorted(images)], 10)
        found.append((method, linear, kernel, kernel / linear if linear > 1e-12 else None))  # images of one span leave nothing
    return rounded(spark.createDataFrame(found, "method string, linear double, kernel double, ratio double"), "linear", "kernel", "ratio", digits=4)


def _selected(rule: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        anchors = an.make_anchors(spark, 100, 64, 2)
        reduced = stable(rd.reduce_locally(dealt(spark, d), anchors, "svd", 12))
        labels = ex.derived_target(anchors.filter("anchor_set = 'anchor'")).select("anchor_id", "target").toPandas().sort_values("anchor_id")  # 100 anchors
        shared, _ = ig.integrate(reduced, 10, "targetvec", anchor_target=labels["target"].to_numpy(), selection=rule)
        images = shared.filter("part = 'anchor_test'").select("institution", F.col("row_id").alias("anchor_id"), "features")
        return rounded(pairs.alignment_pairs(stable(images)), "sum", "mean", "max")

    run.__name__ = f"integrate_targetvec_{rule}_selection"
    return run


for _m in ("forward", "backward"):
    QUERIES[f"integrate_targetvec_{_m}_selection"] = _selected(_m)


def _run(name: str, **settings):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = ex.embeddings(spark, d)
        return ex.run_once(rows, ex.Config(**{"dim_intermediate": 40, **settings}))

    run.__name__ = name
    QUERIES[name] = run


_run("collaboration_imakura")
_run("collaboration_gep_weighted", G_type="GEP_weighted", dim_intermediate=20)
_run("collaboration_joint", G_type="mlp_objective", dim_intermediate=20)
_run("collaboration_linear_objective", G_type="linear_objective", dim_intermediate=20, dim_integrate=10)
_run("collaboration_logistic_objective", G_type="logistic_objective", dim_intermediate=20, dim_integrate=10)
_run("collaboration_nonlinear", G_type="nonlinear", F_type="kernel_pca_svd_mixed", dim_intermediate=20)
_run("baseline_centralize", G_type="centralize")
_run("baseline_centralize_reduced", G_type="centralize_dim")
_run("baseline_individual", G_type="individual")
_run("baseline_individual_reduced", G_type="individual_dim", F_type="kernel_pca_svd_mixed", dim_intermediate=20)
_run("baseline_federated", G_type="fl")
_run("model_random_forest", h_model="random_forest", G_type="centralize")
_run("model_svm_linear", h_model="svm_linear", G_type="centralize", metric="accuracy")
_run("model_svm_rbf", h_model="svm", G_type="centralize", metric="accuracy")
_run("model_svm_fourier", h_model="svm_fourier", G_type="centralize", metric="accuracy")
_run("model_mlp", h_model="mlp", G_type="centralize")


@query(f"WITH s AS ({ORACLES['institution_split']}) SELECT count(*) AS n, 10::INT AS columns, 0.0::DOUBLE AS normal_residual, 1.0::DOUBLE AS least_norm, 1.0::DOUBLE AS greatest_norm, true AS improved, true AS held_improved FROM s WHERE split = 'train'")
def linear_head_identities(spark, d):
    """What must hold of maps trained with a linear head: the head leaves no residual along the mapped rows but the ridge's, columns have B-norm one, and both losses fell."""
    rows = ex.derived_target(dealt(spark, d))
    reduced = stable(rd.reduce_locally(rows, an.make_anchors(spark, 100, 64, 2), "svd", 12))
    _, told = heads.linear_maps(reduced, 10, 4)
    zz, zy = told["own"].normal(told["maps"])
    residual = float(abs(zy - zz @ told["head"] - heads.HEAD_RIDGE * told["head"]).max() / abs(zy).max())
    row = (told["n"], len(told["norms"]), residual, float(told["norms"].min()), float(told["norms"].max()), told["end"] < told["start"], told["held_end"] < told["held_start"])
    return rounded(spark.createDataFrame([row], "n long, columns int, normal_residual double, least_norm double, greatest_norm double, improved boolean, held_improved boolean"), "normal_residual", "least_norm", "greatest_norm")


@query("""WITH t AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_tax::DOUBLE AS c, l_orderkey % 5 AS fold FROM lineitem),
 s AS (SELECT avg(y) my, avg(a) ma, avg(b) mb, avg(c) mc, var_pop(a) aa, var_pop(b) bb, var_pop(c) cc, covar_pop(a, b) ab, covar_pop(a, c) ac, covar_pop(b, c) bc, covar_pop(a, y) ya, covar_pop(b, y) yb, covar_pop(c, y) yc FROM t WHERE fold <> 0),
 e AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
 w AS (SELECT *, (ya * (bb * cc - bc * bc) - ab * (yb * cc - bc * yc) + ac * (yb * bc - bb * yc)) / det AS wa, (aa * (yb * cc - bc * yc) - ya * (ab * cc - bc * ac) + ac * (ab * yc - yb * ac)) / det AS wb, (aa * (bb * yc - yb * bc) - ab * (ab * yc - yb * ac) + ya * (ab * bc - bb * ac)) / det AS wc FROM e)
 SELECT round(1 - avg((y - my - wa * (a - ma) - wb * (b - mb) - wc * (c - mc)) ** 2) / var_pop(y), 6) AS score FROM t, w WHERE fold = 0""")
def model_linear_regression(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("target"), F.array("l_quantity", "l_discount", "l_tax").alias("features"), (F.col("l_orderkey") % 5).alias("fold"))
    scored = mo.fit_and_score(rows.filter("fold <> 0"), rows.filter("fold = 0"), "linear_regression", 1)
    return rounded(mo.evaluate(scored, "r2", 1), "score")


@query()
def model_gradient_boosting(spark, d):
    rows = table(spark, d, "part").select(F.col("p_retailprice").alias("target"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 1000).cast("double")).alias("features"), (F.col("p_partkey") % 5).alias("fold"))
    scored = mo.fit_and_score(rows.filter("fold <> 0"), rows.filter("fold = 0"), "gbt_regression", 1)
    return rounded(mo.evaluate(scored, "rmse", 1), "score", digits=3)


@query("SELECT count(*) FILTER (p_partkey % 5 <> 0) AS n_train, count(*) FILTER (p_partkey % 5 = 0) AS n_test, 8::BIGINT AS n_trials, true AS best_is_least, true AS better_than_mean FROM part")
def boosting_tuned(spark, d):
    """Boosted trees over five folds with searched settings; the mean of the best trial's five models on held-out parts."""
    from .operators import boosting, metrics

    features = F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 1000).cast("double"), F.length("p_name").cast("double"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_retailprice").cast("double").alias("y"), features.alias("features"))
    train, test = rows.filter("row_id % 5 <> 0"), rows.filter("row_id % 5 = 0")
    fitted, models, trials = boosting.tuned(train)
    errors = metrics.rmse_r2(fitted.predict(test, models), "y", "prediction").withColumn("n_test", F.lit(test.count())).withColumn("n_train", F.lit(train.count()))
    least = min(t["rmse"] for t in trials)
    best = trials[models[0].trial]["rmse"] == least
    return errors.select("n_train", "n_test", F.lit(len(trials)).cast("long").alias("n_trials"), F.lit(best).alias("best_is_least"), (F.col("r2") > 0).alias("better_than_mean"))


@query()
def ratings_factorisation(spark, d):
    """Collaborative filtering on (customer, part, quantity): held-out error of alternating least squares."""
    from pyspark.ml.recommendation import ALS

    from .operators import metrics

    r = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item"), F.col("l_quantity").cast("float").alias("rating"), (F.col("l_orderkey") % 5).alias("fold"))
    model = ALS(rank=8, maxIter=5, regParam=0.1, seed=1, userCol="user", itemCol="item", ratingCol="rating", coldStartStrategy="drop").fit(r.filter("fold <> 0"))
    return rounded(metrics.rmse_r2(model.transform(r.filter("fold = 0")), "rating", "prediction"), "rmse", "r2", digits=3)


@query("""WITH r AS (SELECT o_custkey AS u, l_partkey AS i, l_quantity AS q, l_orderkey, l_linenumber, l_orderkey % 5 AS fold FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 t AS (SELECT u, i, avg(q) AS q FROM r WHERE fold <> 0 GROUP BY 1, 2), w AS (SELECT DISTINCT u, i FROM r WHERE fold = 0), n AS (SELECT w.u, w.i, t.u AS v, t.q FROM w JOIN t USING (i) WHERE w.u <> t.u),
 p AS (SELECT DISTINCT u, v FROM n), s AS (SELECT p.u, p.v, 1 / (1 + avg((a.q - b.q) ** 2)) AS s FROM p JOIN t a ON a.u = p.u JOIN t b ON b.u = p.v AND b.i = a.i GROUP BY 1, 2),
 b AS (SELECT u, i, n.q, s FROM n JOIN s USING (u, v) QUALIFY row_number() OVER (PARTITION BY u, i ORDER BY s DESC, v) <= 10),
 e AS (SELECT u, i, sum(s * q) / sum(s) AS e, count(*) AS n FROM b GROUP BY 1, 2)
 SELECT l_orderkey, l_linenumber, round(coalesce(e, (SELECT avg(q) FROM r WHERE fold <> 0)), 6) AS estimate, coalesce(n, 0)::BIGINT AS n_neighbours FROM r LEFT JOIN e USING (u, i) WHERE fold = 0""")
def ratings_neighbours(spark, d):
    """Quantities of held-out order lines, estimated from the ten most similar customers who bought the same part."""
    r = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rating"))
    held = F.col("l_orderkey") % 5 == 0
    found = collaborative.neighbour_estimates(r.filter(~held), r.filter(held), 10, scale=(1.0, 50.0))
    return rounded(found.select("l_orderkey", "l_linenumber", "estimate", "n_neighbours"), "estimate")


def _inverted(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(institution, truth, guess): the cells of the test rows, and what a linear map learned from the anchors makes of their private images."""
    rows = dealt(spark, d)
    anchors = an.make_anchors(spark, 200, 64, 3)
    reduced = rd.reduce_locally(rows, anchors, "samespan", k)
    both = rd.inverted(reduced, anchors).join(rows.select("row_id", F.col("features").alias("truth")), "row_id")
    return both.select("institution", F.explode(F.arrays_zip("truth", "guess")).alias("c")).select("institution", "c.truth", "c.guess")


@query()
def inversion_attack(spark, d):
    """How well a linear map learned from the anchors recovers the test rows behind their private images."""
    from .operators import metrics

    return rounded(metrics.mse_psnr(_inverted(spark, d, 40), "truth", "guess", 1.0, ["institution"]), "mse", "psnr")


@query(INSTITUTIONS_SQL + f" SELECT i AS institution, {USERS * 64}::BIGINT AS n, 0.0::DOUBLE AS worst FROM r")
def inversion_of_full_images(spark, d):
    """Images of full width give every cell away."""
    cells = _inverted(spark, d, 64)
    return rounded(cells.groupBy("institution").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("truth") - F.col("guess"))).alias("worst")), "worst", digits=3)


@query()
def top_singular_value(spark, d):
    """Leading singular value of all embeddings, from a Gram matrix that Spark adds up."""
    rows = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"))
    return rows.limit(1).select(F.round(F.lit(rd.top_singular_value(rows)), 4).alias("singular_value"))


@query()
def grid_run(spark, d):
    """Two methods and a wrong one, two seeds each: failures are rows."""
    combos = grid.product(spark, {"G_type": ["Imakura", "unknown"], "F_type": ["svd"]})
    base = ex.Config(dim_intermediate=20, num_anchor_data=100)
    return rounded(ex.run_grid(ex.embeddings(spark, d), combos, [0, 1], base), "score", "even_mean", "odd_mean", "ind_mean", "even_ind_mean", "odd_ind_mean", digits=4)


@query()
def best_reduction_parameter(spark, d):
    """Each institution's best kernel width, and what its own model reaches with it."""
    return rounded(ex.best_ratios(ex.embeddings(spark, d), ex.Config(F_type="kernel_pca_self_tuning", dim_intermediate=10), (0.1, 1.0, 10.0)), "score", digits=4)


@query()
def reduction_benchmark(spark, d):
    return rounded(ex.reduction_benchmark(ex.embeddings(spark, d), [120], [8], ["svd", "kernel_pca_self_tuning"], ex.Config()), "auc", "delta_vs_pca", digits=4)


@query()
def reduction_benchmark_by_classifier(spark, d):
    """Half of all training rows, by method and classifier: a size that follows the table."""
    rows = ex.embeddings(spark, d)
    n = max(80, rows.count() // 4 // 4 * 4)
    return rounded(ex.reduction_benchmark(rows, [n], [8], ["svd", "cca"], ex.Config(), classifiers=("softmax", "svm")), "auc", "delta_vs_pca", digits=4)


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return ex.embeddings(spark, d).select(F.col("row_id").alias("key"), F.when(F.col("row_id") % 4 == 0, "test").otherwise("train").alias("part"), "features", F.col("target").alias("label"))


@query()
def neighbour_layout(spark, d):
    """All embeddings in two dimensions by their neighbours, edges between classes weakened."""
    from .operators import manifold

    places = manifold.layout(_numbered(spark, d), 2, label="label", rounds=12)
    return places.select("key", F.round(F.col("place")[0], 2).alias("x"), F.round(F.col("place")[1], 2).alias("y"))


@query("SELECT count(*) FILTER (vec_id % 4 <> 0) AS n_train, count(*) AS n_codes, 8::INT AS width, true AS not_above_components FROM embeddings")
def autoencoder_codes(spark, d):
    """Codes of eight numbers; the error on the training rows is not above that of eight principal components."""
    from .operators import manifold

    rows = _numbered(spark, d)
    codes, errors = manifold.autoencoder(rows, 8, rounds=10)
    told = codes.agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count(F.lit(1)).alias("n_codes"), F.max(F.size("features")).alias("width"))
    return told.withColumn("not_above_components", F.lit(min(errors) <= errors[0]))
