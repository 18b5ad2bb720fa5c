"""Evaluation metrics as aggregates and windows over value counts, never over single rows of a group.

AUC is the exact Mann-Whitney statistic with mid-ranks. Rows are first summed per distinct score; the running count over
scores then needs one row per distinct score, and is taken over range partitions, so that no key's scores meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable


def auc_binary(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n_pos, n_neg, auc (null if one class is absent)."""
    y = F.col(label).cast("int")
    ties = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("__s")).agg(F.sum(y).alias("__p"), F.sum(1 - y).alias("__n"))
    # range partitions over keys and score: each is counted by itself and shifted by the same key's counts in the parts before it
    cut = stable(ties.repartitionByRange(*keys, "__s").withColumn("__part", F.spark_partition_id()))
    parts = cut.groupBy("__part", *keys).agg(F.sum("__n").alias("__all"))
    zero = F.lit(0).cast("long")
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part that holds the key
    shifts = parts.select(F.col("__part").alias("__at"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__all").over(ahead), zero).alias("__ahead"))
    same = F.col("__part") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    order = Window.partitionBy("__part", *keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("__own", F.coalesce(F.sum("__n").over(order), zero)).join(shifts, same).withColumn("__below", F.col("__own") + F.col("__ahead"))
    wins = F.sum(F.col("__p") * (F.col("__below") + F.col("__n") / 2))
    sums = ranked.groupBy(*keys).agg(F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg"), wins.alias("__wins"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return sums.select(*keys, "n_pos", "n_neg", F.when(pairs > 0, F.col("__wins") / pairs).alias("auc"))


def auc_one_vs_rest(df: DataFrame, label: str, scores: str, n_classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over classes of the binary AUC of each class's score; ``scores`` is an array indexed by the class code."""
    long = df.select(*keys, F.col(label).alias("__y"), F.posexplode(F.slice(scores, 1, n_classes)).alias("__class", "__score"))
    each = auc_binary(long.withColumn("__is", (F.col("__y") == F.col("__class")).cast("int")), "__is", "__score", [*keys, "__class"])
    return each.groupBy(*keys).agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_classes"))


def accuracy(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def rmse_r2(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """r2 is null if the truth does not vary."""
    t, e = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(predicted)
    spread = F.var_pop(t) * F.count(t)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"))


def mse_psnr(df: DataFrame, truth: str, predicted: str, peak: float, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col(truth).cast("double") - F.col(predicted)
    mse = F.avg(e * e)
    return df.groupBy(*keys).agg(mse.alias("mse"), F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse)).alias("psnr"))


def moments(df: DataFrame, institution: Column, columns: Sequence[str]) -> DataFrame:
    """(feature, n, mean, var, sigma) over all rows, from each institution's n, mean and squared deviations alone; sigma 0 becomes 1.

    Deviations are merged about the common mean, so columns far from 0 lose no digits. Null cells count for no feature.
    """
    stats = [f.alias(f"{a}_{c}") for c in columns for a, f in (("n", F.count(c)), ("m", F.avg(c)), ("v", F.var_pop(c)))]
    wide = df.groupBy(institution.alias("institution")).agg(*stats)
    one = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("m"), F.col(f"v_{c}").alias("v")) for c in columns])
    local = wide.select(F.explode(one).alias("r")).select("r.*").filter("n > 0")
    centre = local.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    off = F.col("m") - F.col("mean")
    merged = local.join(F.broadcast(centre), "feature").groupBy("feature").agg(F.sum("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("n") * (F.col("v") + off * off)).alias("m2"))  # a row for each column
    var = F.col("m2") / F.col("n")
    return merged.select("feature", "n", "mean", var.alias("var"), F.when(var > 0, F.sqrt(var)).otherwise(1.0).alias("sigma"))


def least_squares(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Coefficients of y on two features and a constant, from sums in one pass (centred normal equations)."""
    c = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"), F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"))
    d = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = F.when(d != 0, (F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y")) / d)
    b2 = F.when(d != 0, (F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y")) / d)
    return c.select("n", b1.alias("b1"), b2.alias("b2")).join(c.select("my", "m1", "m2")).select("n", "b1", "b2", (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"))
