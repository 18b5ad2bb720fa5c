"""Runs of the whole method: split, reduce, align, fit once, evaluate by institution, beside its baselines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import eigen_weights
from ..operators import anchors as an
from ..operators import federated as fed
from ..operators import heads
from ..operators import integrate as ig
from ..operators import joint
from ..operators import models as mo
from ..operators import reduce as rd
from ..operators import split as sp
from ..session import stable, table
from ..sources import sinks

BASELINES = ("centralize", "centralize_dim", "individual", "individual_dim", "fl")
#: Ratios of the kernel width that a search tries.
RATIOS = (1e-7, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0)


@dataclass(frozen=True)
class Config:
    """Everything a run depends on. The split's seed and the run's seed are separate."""

    F_type: str = "svd"
    G_type: str = "Imakura"
    h_model: str = "softmax"
    metric: str = "auc"
    num_anchor_data: int = 300
    anchor_method: str = "gaussian"
    dim_intermediate: int = 20
    dim_integrate: int | None = None
    num_institution: int | None = None
    num_institution_user: int = 50
    gamma_type: str = "auto"
    gamma_ratio: float = 1.0
    gamma_ratio_krr: float = 1.0
    nl_lambda: float = 0.1
    weight_pred: float = 1.0
    joint_rounds: int = joint.ROUNDS
    split_seed: int = 42
    run_seed: int = 0


def derived_target(rows: DataFrame) -> DataFrame:
    """Four classes that a linear model can learn from the first sixteen features (the table's own label is noise)."""
    half = lambda lo: F.aggregate(F.slice(F.transform("features", lambda x: x.cast("double")), lo, 8), F.lit(0.0), lambda s, v: s + v) > 0
    return rows.withColumn("target", (half(1).cast("int") + 2 * half(9).cast("int")).cast("int"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"))
    return derived_target(rows)


def split_rows(rows: DataFrame, config: Config) -> tuple[DataFrame, int]:
    """(rows with institution and split, classes): checkpointed, since every later step must see the same assignment."""
    counts = rows.groupBy("target").count()
    n, least, classes = counts.agg(F.sum("count"), F.min("count"), F.count(F.lit(1))).first()
    shape = sp.resolve_shape(n or 0, least or 0, 0, config.num_institution, config.num_institution_user)
    order = [F.xxhash64("row_id", F.lit(config.split_seed)), F.col("row_id")]
    return stable(sp.covering_split(rows, "target", shape.institutions, shape.rows, order)), classes


def run_once(rows: DataFrame, config: Config) -> DataFrame:
    """(institution, n_test, score_individual, score): the method, or the baseline that ``G_type`` names."""
    dealt, classes = split_rows(rows, config)
    dim = len(dealt.select("features").first()[0])
    k = config.dim_intermediate
    plain = dealt.select(F.col("institution").cast("int").alias("institution"), F.col("split").alias("part"), "row_id", "target", "features")
    keys = ("institution",)
    if config.G_type in ("centralize", "centralize_dim"):
        pooled = stable(rd.reduce_pooled(plain, "kernel_pca", config.dim_integrate or k)) if config.G_type == "centralize_dim" else plain
        scored = mo.fit_and_score(pooled.filter("part = 'train'"), pooled.filter("part = 'test'"), config.h_model, classes, config.run_seed)
    elif config.G_type == "individual":
        scored = mo.individual(plain, classes)
    elif config.G_type == "individual_dim":
        scored = mo.individual(_own_reduced(dealt, config, dim), classes)
    elif config.G_type == "fl":
        scored = fed.federated(plain, classes, config.run_seed)
    else:
        ranges = an.ranges_of(plain.filter("part = 'train'")) if config.anchor_method == "uniform" else None
        anchors = an.make_anchors(rows.sparkSession, config.num_anchor_data, dim, config.run_seed, config.anchor_method, ranges)
        reduced = stable(rd.reduce_locally(dealt, anchors, config.F_type, k, config.run_seed, config.gamma_ratio))
        if config.G_type == "mlp_objective":
            maps, _ = joint.joint_maps(reduced, config.dim_integrate or k, classes, config.weight_pred, rounds=config.joint_rounds, seed=config.run_seed)
            shared = ig.project(reduced, maps)
        elif config.G_type in heads.HEADS:
            maps, _ = heads.head_maps(reduced, config.dim_integrate or k, classes, config.G_type, weight_pred=config.weight_pred, seed=config.run_seed)
            shared = ig.project(reduced, maps)
        else:
            shared, maps = ig.integrate(reduced, config.dim_integrate or k, config.G_type, penalty=config.nl_lambda, width=config.gamma_type, width_ratio=config.gamma_ratio_krr)
        shared = stable(shared)
        weights = eigen_weights(maps.values) if config.G_type == "GEP_weighted" else None
        scored = mo.fit_and_score(shared.filter("part = 'train'"), shared.filter("part = 'test'"), config.h_model, classes, config.run_seed, weights=weights)
    scores = mo.evaluate(scored, config.metric, classes, keys)
    own = mo.evaluate(mo.individual(plain, classes), config.metric, classes, keys).withColumnRenamed("score", "score_individual")
    sizes = plain.filter("part = 'test'").groupBy("institution").agg(F.count(F.lit(1)).alias("n_test"))
    return sizes.join(own, "institution", "left").join(scores, "institution", "left").select("institution", "n_test", "score_individual", "score")


def _own_reduced(dealt: DataFrame, config: Config, width: int, ratio: float | None = None) -> DataFrame:
    """Each institution's rows in its own reduced space: no anchors, nothing shared."""
    none = an.make_anchors(dealt.sparkSession, 1, width, config.run_seed)
    reduced = rd.reduce_locally(dealt, none, config.F_type, config.dim_intermediate, config.run_seed, config.gamma_ratio if ratio is None else ratio)
    return reduced.filter(F.col("part").isin("train", "test")).drop("gamma")


def best_ratios(rows: DataFrame, config: Config, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """(institution, best_param, score): the ratio of the kernel width with which each institution's own model does best; the least one on ties."""
    dealt, classes = split_rows(rows, config)
    width, found = len(dealt.select("features").first()[0]), None
    for ratio in ratios:
        scored = mo.evaluate(mo.individual(_own_reduced(dealt, config, width, ratio), classes), config.metric, classes, ("institution",))
        told = scored.select("institution", F.lit(float(ratio)).alias("best_param"), "score")
        found = told if found is None else found.unionByName(told)
    order = F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("best_param"))
    return found.groupBy("institution").agg(F.max_by(F.struct("best_param", "score"), order).alias("b")).select("institution", "b.best_param", "b.score")


def run_grid(rows: DataFrame, combos: DataFrame, seeds: Sequence[int] = range(5), base: Config | None = None, log: str | None = None, dump: str | None = None) -> DataFrame:
    """One row per combination and seed: its parameters, status, error, and means over all, even and odd institutions.

    Each run is a Spark job of its own; one that fails becomes a row with its error and stops nothing. With ``log``, a folder, every row is appended there as soon
    as it is known, and runs that ended well in an earlier call are taken from it: a grid that is cut short goes on where it stopped. With ``dump``, the whole grid is written there as CSV at the end.
    """
    base = base or Config()
    settings = {f.name for f in fields(Config)}
    names = [c for c in combos.columns if c in settings]
    kinds = {f.name: f.dataType.simpleString() for f in combos.schema}
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "run_seed int, status string, error string, score double, even_mean double, odd_mean double, ind_mean double, even_ind_mean double, odd_ind_mean double"])
    told = [n.split()[0] for n in schema.split(", ")]
    known = {}
    if log is not None and sinks.exists(rows.sparkSession, log):
        before = sinks.read_log(rows.sparkSession, log)
        if set(names) <= set(before.columns):
            known = {tuple(r[n] for n in (*names, "run_seed")): tuple(r) for r in before.filter("status = 'ok'").select(*told).collect()}  # runs, not rows
    out = []
    for combo in combos.select(*names).collect():  # the grid is the caller's list of runs
        for seed in seeds:
            if (done := known.get((*combo, int(seed)))) is not None:
                out.append(dict(zip(told, done, strict=True)))
                continue
            config = replace(base, **{k: v for k, v in combo.asDict().items() if v is not None}, run_seed=int(seed))
            row = {**combo.asDict(), "run_seed": int(seed), "status": "ok", "error": None, "score": None, "even_mean": None, "odd_mean": None, "ind_mean": None, "even_ind_mean": None, "odd_ind_mean": None}
            try:
                even = F.col("institution") % 2 == 0
                found = run_once(rows, config).agg(F.avg("score").alias("score"), F.avg(F.when(even, F.col("score"))).alias("even_mean"), F.avg(F.when(~even, F.col("score"))).alias("odd_mean"), F.avg("score_individual").alias("ind_mean"),
                                                   F.avg(F.when(even, F.col("score_individual"))).alias("even_ind_mean"), F.avg(F.when(~even, F.col("score_individual"))).alias("odd_ind_mean")).first()
                row |= found.asDict()
            except Exception as e:  # noqa: BLE001  a failed run is a result
                row |= {"status": "failed", "error": str(e)[:300]}
            out.append(row)
            if log is not None:
                sinks.append_log(rows.sparkSession.createDataFrame([tuple(row.values())], schema), log)
    found = rows.sparkSession.createDataFrame([tuple(r.values()) for r in out], schema)
    if dump is not None:
        sinks.write_csv(found.coalesce(1), dump)  # the caller's list of runs
    return found


def reduction_benchmark(rows: DataFrame, sizes: Sequence[int], dims: Sequence[int], methods: Sequence[str], config: Config | None = None, classifiers: Sequence[str] = ("softmax",)) -> DataFrame:
    """(n_train, dim, method, clf, auc, delta_vs_pca): pooled training rows reduced by each method, then each classifier."""
    config = config or Config()
    dealt, classes = split_rows(rows, config)
    width = len(dealt.select("features").first()[0])
    anchors = an.make_anchors(rows.sparkSession, 1, width, 0)
    out = []
    for n in sizes:
        order = [F.xxhash64("row_id", F.lit(7)), F.col("row_id")]
        some = stable(sp.stratified_subsample(dealt.filter("split = 'train'"), "target", n, order).unionByName(dealt.filter("split = 'test'")))
        for dim in dims:
            for method in methods:
                if method in rd.POOLED:
                    reduced = stable(rd.reduce_pooled(some.withColumnRenamed("split", "part"), method, dim))
                else:  # the rows of a stated size, as one institution's
                    reduced = rd.reduce_locally(some.withColumn("institution", F.lit(0)), anchors, method, dim).drop("gamma")
                for clf in classifiers:
                    scored = mo.fit_and_score(reduced.filter("part = 'train'"), reduced.filter("part = 'test'"), clf, classes)
                    out.append((n, dim, method, clf, mo.evaluate(scored, "auc", classes).first()["score"]))
    found = rows.sparkSession.createDataFrame(out, "n_train int, dim int, method string, clf string, auc double")
    base = found.filter("method = 'svd'").select("n_train", "dim", "clf", F.col("auc").alias("base"))
    return found.join(base, ["n_train", "dim", "clf"], "left").select("n_train", "dim", "method", "clf", "auc", (F.col("auc") - F.col("base")).alias("delta_vs_pca"))
