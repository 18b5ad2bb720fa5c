"""Parameter grids: products, rules, seeds from earlier results, defaults. All as DataFrames of tiny tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``when`` all listed columns hold one of the listed values: fix ``lock`` columns, or skip the combination."""

    when: dict[str, Sequence]
    lock: dict[str, object] = field(default_factory=dict)

    def matches(self, columns: Sequence[str]) -> F.Column:
        out = F.lit(True)
        for c, values in self.when.items():
            out = out & (F.coalesce(F.col(c).isin(*values), F.lit(False)) if c in columns else F.lit(False))
        return out


def product(spark: SparkSession, lists: dict[str, DataFrame | Sequence]) -> DataFrame:
    """All combinations. An empty list gives no combination at all; leave the parameter out to have its default."""
    out = None
    for name, values in lists.items():
        one = values.select(F.col(values.columns[0]).alias(name)) if isinstance(values, DataFrame) else spark.createDataFrame([(v,) for v in values], [name]) if values else None
        if one is None:
            raise ValueError(f"no values for {name}: leave it out to have its default")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def apply_rules(combos: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules in order, each seeing what those before it fixed; then combinations that have become equal are one."""
    for r in rules:
        hit = r.matches(combos.columns)
        if not r.lock:
            combos = combos.filter(~hit)
            continue
        for c, v in r.lock.items():
            fixed = F.lit(v)
            combos = combos.withColumn("__hit", hit).withColumn(c, F.when(F.col("__hit"), fixed.cast(combos.schema[c].dataType) if c in combos.columns else fixed).otherwise(F.col(c) if c in combos.columns else F.lit(None))).drop("__hit")
    return combos.dropDuplicates()


def seeded_combos(results: DataFrame, methods: dict[str, Sequence[str]], grid: dict[str, DataFrame | Sequence], rules: Sequence[Rule], method: str = "G_type") -> DataFrame:
    """Grid combinations whose keys come from earlier results of some methods; other methods take the plain grid."""
    spark = results.sparkSession
    out = apply_rules(product(spark, grid), rules).filter(~F.coalesce(F.col(method).isin(*methods), F.lit(False)))
    for name, keys in methods.items():
        fixed = results.filter(F.col(method) == name).dropna(subset=list(keys)).select(*keys).dropDuplicates()
        rest = {k: v for k, v in grid.items() if k not in keys}
        combos = fixed.crossJoin(F.broadcast(product(spark, rest))) if rest else fixed
        out = out.unionByName(apply_rules(combos, rules).select(*out.columns))
    return out


def is_empty(column: str, kind: str) -> F.Column:
    """Null, a negative number, or a text that says nothing."""
    c = F.col(column)
    if kind == "string":
        return c.isNull() | F.lower(F.trim(c)).isin("", "undefined", "none")
    return c.isNull() if kind == "boolean" else c.isNull() | (c < 0)


def with_defaults(combos: DataFrame, by_dataset: DataFrame, overall: dict[str, object]) -> DataFrame:
    """Own value, else the data set's default, else the overall one."""
    defaults = by_dataset.select(F.col("dataset").alias("__dataset"), *[F.col(c).alias(f"__{c}") for c in by_dataset.columns if c != "dataset"])
    out = combos.join(F.broadcast(defaults), F.col("dataset") == F.col("__dataset"), "left")  # one row per known data set
    for name in dict.fromkeys([*[c for c in by_dataset.columns if c != "dataset"], *overall]):
        kind = dict(combos.dtypes).get(name)
        own = F.when(~is_empty(name, kind), F.col(name)) if kind else F.lit(None)
        options = [own, *([F.col(f"__{name}")] if name in by_dataset.columns else []), *([F.lit(overall[name])] if overall.get(name) is not None else [])]
        out = out.withColumn(name, F.coalesce(*options))
    return out.drop(*defaults.columns)
