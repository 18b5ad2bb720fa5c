"""Relational questions over a table of experiment results (one row per parameter combination).

Ties and "first" follow an explicit row id, never the order in which rows happen to arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import number_text
from ..operators.ranking import first_per_group

FINE = ["dataset", "h_model", "F_type", "gamma_type", "gamma_ratio", "num_anchor_data", "dim_intermediate", "num_institution_user"]
COARSE = ["dataset", "h_model", "F_type", "gamma_type", "num_institution_user"]
BASELINES = ("Imakura", "GEP", "ODC")


def best_per_group(df: DataFrame, keys: Sequence[str], score: str = "score_mean", row_id: str = "row_id") -> DataFrame:
    """The row with the greatest score in each group; on ties the first by row id. Null scores lose."""
    return first_per_group(df.filter(F.col(score).isNotNull()), keys, [-F.col(score), row_id])


def ranked_combinations(df: DataFrame, keys: Sequence[str], columns: Sequence[str], score: str = "score_mean") -> DataFrame:
    """How often each combination of ``columns`` wins its group, and its mean winning score."""
    return best_per_group(df, keys, score).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))


def config_id(df: DataFrame) -> DataFrame:
    return df.withColumn("nonlinear_config_id", F.concat_ws("+", "G_type", number_text(F.col("gamma_ratio_krr")), number_text(F.col("nl_lambda"))))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join that takes null keys for equal; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__{k}"])
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def beat_baselines(df: DataFrame, candidate: str = "nonlinear", baselines: Sequence[str] = BASELINES, keys: Sequence[str] = FINE) -> DataFrame:
    """Rows of ``candidate`` whose score exceeds every baseline of their group; groups without a baseline give none."""
    best = df.filter(F.col("G_type").isin(*baselines)).groupBy(*keys).agg(F.max("score_mean").alias("__best"))
    joined = null_safe(df.filter(F.col("G_type") == candidate), best, keys, "inner")
    return joined.filter(F.col("score_mean") > F.col("__best")).drop("__best")


def beat_own_institutions(df: DataFrame) -> DataFrame:
    return df.filter((F.col("odd_mean") > F.col("odd_ind_mean")) & (F.col("even_mean") > F.col("even_ind_mean")))


def individual_reference(df: DataFrame, keys: Sequence[str] = COARSE) -> DataFrame:
    """One reference row per coarse group, the first by row id, so a join to it is many-to-one by construction."""
    own = df.filter(F.col("G_type") == "individual").select(*keys, "row_id", "score_mean", "odd_mean", "even_mean")
    first = first_per_group(own, keys, ["row_id"])
    return first.select(*keys, F.col("score_mean").alias("ind_score_mean"), F.col("odd_mean").alias("ind_odd_mean"), F.col("even_mean").alias("ind_even_mean"))


def beat_individual(df: DataFrame, reference: DataFrame, keys: Sequence[str] = COARSE) -> DataFrame:
    joined = null_safe(df.filter(F.col("G_type") != "individual"), reference, keys, "left")
    return joined.filter((F.col("score_mean") > F.col("ind_score_mean")) & (F.col("odd_mean") > F.col("ind_odd_mean")) & (F.col("even_mean") > F.col("ind_even_mean")))


def pivot_first(df: DataFrame, keys: Sequence[str], by: str, values: Sequence[str], value: str) -> DataFrame:
    """A column for each of ``values``: the first ``value`` by row id of each group."""
    firsts = [F.min_by(F.when(F.col(by) == v, F.col(value)), F.when(F.col(by) == v, F.col("row_id"))).alias(v) for v in values]
    return df.filter(F.col(by).isin(*values)).groupBy(*keys).agg(*firsts)


def with_methods(df: DataFrame, all_rows: DataFrame, keys: Sequence[str] = FINE, methods: Sequence[str] = ("GEP", "ODC", "Imakura")) -> DataFrame:
    """The scores of other methods with the same keys, as columns; null keys match null keys."""
    return null_safe(df, pivot_first(all_rows, keys, "G_type", methods, "score_mean"), keys, "left")


def wide_best(df: DataFrame, keys: Sequence[str], cells: dict[str, Column], score: str = "score_mean", digits: int = 4) -> DataFrame:
    """One column per condition: the best score among the rows that meet it, rounded, null if none does."""
    return df.groupBy(*keys).agg(*[F.round(F.max(F.when(c, F.col(score))), digits).alias(name) for name, c in cells.items()])


def top_distinct(df: DataFrame, keys: Sequence[str], score: str, n: int = 3, smaller_is_better: Column | None = None) -> DataFrame:
    """Rows whose score is among the n best distinct values of their group, with that rank.

    The distinct values are cut to n by an aggregate before any row is joined to them: no group is sorted as a whole.
    """
    sign = F.when(smaller_is_better, 1).otherwise(-1) if smaller_is_better is not None else F.lit(-1)
    signed = df.withColumn("__s", sign * F.col(score))
    values = signed.select(*keys, "__s").filter("__s IS NOT NULL").distinct()
    from pyspark.sql import Window

    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__s"))).filter(F.col("rank") <= n)
    return null_safe(signed, ranked, [*keys, "__s"], "inner").drop("__s")


def preferred_row(df: DataFrame, keys: Sequence[str], prefer: Column, row_id: str = "row_id") -> DataFrame:
    """The first row that meets ``prefer``, else the first row."""
    return first_per_group(df, keys, [F.when(prefer, 0).otherwise(1), row_id])


def group_means(df: DataFrame, keys: Sequence[str], values: Sequence[str], drop_null_keys: bool = False) -> DataFrame:
    rows = df.dropna(subset=list(keys)) if drop_null_keys else df
    return rows.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def seed_summary(df: DataFrame, keys: Sequence[str], score: str, ok: Column) -> DataFrame:
    """Mean and sample deviation of the successful runs; 0 where none, or one, succeeded."""
    s = F.when(ok, F.col(score))
    return df.groupBy(*keys).agg(F.count(s).alias("n_ok"), F.coalesce(F.avg(s), F.lit(0.0)).alias("score_mean"), F.coalesce(F.when(F.count(s) > 1, F.stddev_samp(s)), F.lit(0.0)).alias("score_stdev"))


def delta_to(df: DataFrame, keys: Sequence[str], by: str, base: str, score: str) -> DataFrame:
    """Score less the best score of method ``base`` with the same keys; null without one."""
    best = df.filter(F.col(by) == base).groupBy(*keys).agg(F.max(score).alias("__base"))
    return null_safe(df, best, keys, "left").withColumn("delta", F.col(score) - F.col("__base")).drop("__base")


def institution_means(df: DataFrame, keys: Sequence[str], institution: str, score: str) -> DataFrame:
    """Mean, least and greatest over institutions, and the means of even and odd ones."""
    even = F.col(institution) % 2 == 0
    return df.groupBy(*keys).agg(F.avg(score).alias("mean"), F.min(score).alias("least"), F.max(score).alias("greatest"), F.round(F.avg(F.when(even, F.col(score))), 4).alias("even_mean"), F.round(F.avg(F.when(~even, F.col(score))), 4).alias("odd_mean"))


def in_custom_order(df: DataFrame, column: str, order: Sequence[str], *then: str | Column) -> DataFrame:
    """Sorted by place in ``order``; values that it lacks come last."""
    place = F.lit(999)
    for i, v in reversed(list(enumerate(order))):
        place = F.when(F.col(column) == v, i).otherwise(place)
    return df.withColumn("place", place).orderBy("place", *then)


def union_with_origin(parts: dict[str, DataFrame], name: str) -> DataFrame:
    out = None
    for origin, df in parts.items():
        tagged = df.withColumn(name, F.lit(origin))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
