"""Preparation of tables: label codes, rare labels, dummies, standard scores, bins, imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import impute
from .ranking import global_row_number

#: Levels of a categorical column that may become columns or codes held by the driver.
MAX_LEVELS = 10_000


def levels_of(df: DataFrame, column: str) -> list:
    """Sorted distinct values; an error, not a cut, beyond MAX_LEVELS."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels")
    return found


def encode_labels(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Code of each value: its 0-based rank among the sorted distinct values, numbered by range partitions."""
    distinct = df.select(F.col(column).alias("__level")).distinct().filter("__level IS NOT NULL")
    ranked = global_row_number(distinct, ["__level"], name).withColumn(name, F.col(name).cast("int"))
    return df.join(ranked, F.col(column) == F.col("__level"), "left").drop("__level")


def drop_rare_labels(df: DataFrame, column: str, min_count: int = 2) -> DataFrame:
    kept = df.groupBy(column).count().filter(F.col("count") >= min_count).select(column)
    return df.join(kept, column, "left_semi")


def one_hot(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Dummies on the right, without the first sorted level; numbers stay where they are."""
    prefix = column if prefix is None else prefix
    dummies = [F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}") for v in levels_of(df, column)[1:]]
    return df.select(*[c for c in df.columns if c != column], *dummies)


def cap_features(df: DataFrame, features: Sequence[str], n: int) -> list[str]:
    """The first n features in column order: dummies stand on the right and go first."""
    return [c for c in df.columns if c in set(features)][:n]


def standardise(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation, a deviation of 0 taken as 1. Fitted on ``fit_on`` (a training side), else on all rows."""
    stats = (df if fit_on is None else fit_on).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(stats))  # one row by construction
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def feature_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, low, high), blind to NaN; -1 and 1 where nothing finite is left."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c).cast("double"))
    sums = df.agg(*[f(finite(c)).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"lo_{c}") + 0.0, F.lit(-1.0)).alias("low"), F.coalesce(F.col(f"hi_{c}") + 0.0, F.lit(1.0)).alias("high")) for c in columns]))
    return sums.select(rows.alias("r")).select("r.*")


def three_way_bins(df: DataFrame, column: str, low: float, high: float, min_count: int = 10, name: str = "target") -> DataFrame:
    """``low`` up to the lower bound, ``high`` from the upper one, else ``mid``; two ways, split between them at the
    lower bound, if any class has fewer than ``min_count`` rows."""
    three = F.when(F.col(column) <= low, "low").when(F.col(column) >= high, "high").otherwise("mid")
    two = F.when(F.col(column) <= low, "low").otherwise("high")
    counts = df.agg(*[F.sum((three == c).cast("long")).alias(c) for c in ("low", "mid", "high")]).select((F.least("low", "mid", "high") >= min_count).alias("__enough"))
    return df.crossJoin(F.broadcast(counts)).withColumn(name, F.when(F.col("__enough"), three).otherwise(two)).drop("__enough")


def knn_impute(df: DataFrame, key: str, columns: Sequence[str], k: int = 5, n_cells: int | None = None) -> DataFrame:
    """Null cells become the mean of that column over the k nearest rows that have it, by the distance over columns both have
    (scaled up for the missing ones; ties by key); a column's mean where there is none. Every other row may be a donor; keys are distinct."""
    names = list(columns)
    found = impute(df, key, names, k, n_cells).groupBy("key").pivot("slot", list(range(len(names)))).agg(F.first("mean"))
    wide = found.select(F.col("key").alias("__hole"), *[F.col(f"`{i}`").alias(f"__n_{c}") for i, c in enumerate(names)])
    out = df.join(wide, F.col(key) == F.col("__hole"), "left").crossJoin(F.broadcast(df.agg(*[F.avg(c).alias(f"__m_{c}") for c in names])))  # one row
    return out.select(*[F.coalesce(F.col(c), F.col(f"__n_{c}"), F.col(f"__m_{c}")).alias(c) if c in names else F.col(c) for c in df.columns])
