"""Assignment of rows to institutions, so that every institution sees every class on both sides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_row_number


@dataclass(frozen=True)
class Shape:
    """Sizes of a split: institutions, rows of each per side, features, dimensions of the local and the shared space."""

    institutions: int
    rows: int
    features: int
    dim_local: int
    dim_shared: int


def resolve_shape(n_rows: int, min_class: int, n_features: int, institutions: int | None = None, rows: int | None = None, features: int | None = None, dim_local: int | None = None, dim_shared: int | None = None) -> Shape:
    """Fill what is not given: all features, one dimension less, as many shared ones, 50 rows, and as many institutions as
    rows and the rarest class allow. Values below 1 count as not given."""
    given = lambda v: v is not None and v > 0
    f = min(features, n_features) if given(features) else n_features
    local = dim_local if given(dim_local) else max(1, f - 1)
    shared = dim_shared if given(dim_shared) else local
    u = rows if given(rows) else 50
    m = institutions if given(institutions) else max(1, min(n_rows // (2 * u), min_class // 2))
    return Shape(m, u, f, local, shared)


def check_shape(df: DataFrame, label: str, institutions: int, rows: int) -> int:
    """Raise what makes a covering split impossible; return the number of classes."""
    counts = df.groupBy(label).count()
    n, classes, least = counts.agg(F.sum("count"), F.count(F.lit(1)), F.min("count")).first()
    if 2 * institutions * rows > (n or 0):
        raise ValueError(f"{2 * institutions * rows} rows are asked for, {n or 0} are there")
    if rows < classes:
        raise ValueError(f"{rows} rows per institution cannot hold {classes} classes")
    if least < 2 * institutions:
        raise ValueError(f"a class has {least} rows, fewer than two per institution")
    return classes


def covering_split(df: DataFrame, label: str, institutions: int, rows: int, order: Sequence[Column], seed: int = 42) -> DataFrame:
    """Rows with ``split`` (train, test), ``institution``, and no rows beyond the 2 * institutions * rows that are dealt.

    Per class the first m rows in ``order`` go to the training bins 0 .. m-1 and the next m to the test bins. The rest
    fills the bins in one global order: each lacks rows - classes rows. The per-class ranks stop at 2m, which Spark
    prunes before it shuffles; the global order is numbered without gathering it. ``order`` must be a total order.
    """
    m, u = institutions, rows
    classes = check_shape(df, label, m, u)
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    head = ranked.filter(F.col("__rank") <= 2 * m)
    first = head.withColumn("split", F.when(F.col("__rank") <= m, "train").otherwise("test")).withColumn("institution", ((F.col("__rank") - 1) % m).cast("int"))
    lack = u - classes
    if not lack:
        return first.drop("__rank")
    keys = head.select(*[c.alias(f"__o{i}") for i, c in enumerate(order)])
    rest = df.select("*", *[c.alias(f"__o{i}") for i, c in enumerate(order)]).join(keys, [f"__o{i}" for i in range(len(order))], "left_anti")
    placed = global_row_number(rest, [F.col(f"__o{i}") for i in range(len(order))], "__place").filter(F.col("__place") < 2 * m * lack)
    more = placed.withColumn("split", F.when(F.col("__place") < m * lack, "train").otherwise("test")).withColumn("institution", (F.floor(F.col("__place") / lack) % m).cast("int"))
    return first.drop("__rank").unionByName(more.drop("__place", *[f"__o{i}" for i in range(len(order))]))


def buckets(df: DataFrame, order: Sequence[str], rows: int, institutions: int) -> DataFrame:
    """Institution by place: rows k * u .. (k + 1) * u - 1 of the order go to institution k; later rows go nowhere."""
    placed = global_row_number(df, list(order), "__place").filter(F.col("__place") < rows * institutions)
    return placed.withColumn("institution", F.floor(F.col("__place") / rows).cast("int")).drop("__place")


def class_coverage(df: DataFrame, label: str) -> DataFrame:
    """(split, institution, n_rows, n_classes, complete): does every bin hold every class?"""
    total = df.agg(F.countDistinct(label).alias("__all"))
    return df.groupBy("split", "institution").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(label).alias("n_classes")).crossJoin(F.broadcast(total)).withColumn("complete", F.col("n_classes") == F.col("__all")).drop("__all")


def stratified_subsample(df: DataFrame, label: str, n: int, order: Sequence[Column]) -> DataFrame:
    """About n rows that keep the classes' shares: from each class the first round(n * share) in the order."""
    counts = df.groupBy(F.col(label).alias("__label")).count().withColumnRenamed("count", "__n")
    total = df.count()
    joined = df.join(counts, F.col(label) == F.col("__label"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return joined.withColumn("__rank", rank).filter(F.col("__rank") <= F.round(F.col("__n") * n / max(total, 1))).drop("__rank", "__n", "__label")
