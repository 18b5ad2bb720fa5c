"""Anchor rows that all institutions share: random rows that carry no institution's data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("gaussian", "uniform", "unit")
SETS = ("anchor", "anchor_test")


def make_anchors(spark: SparkSession, rows: int, features: int, seed: int, method: str = "gaussian", ranges: DataFrame | None = None) -> DataFrame:
    """(anchor_set, anchor_id, features): a set to align by and one to test with.

    ``uniform`` draws within (feature, low, high) of ``ranges``, features in name order; these ranges leak the data's bounds.
    """
    if method not in METHODS:
        raise ValueError(f"anchor method must be one of {METHODS}, not {method!r}")
    if method == "uniform":
        if ranges is None:
            raise ValueError("uniform anchors need feature ranges")
        bounds = [(r["low"], r["high"]) for r in ranges.orderBy("feature").collect()]
    out = None
    for i, name in enumerate(SETS):
        draws = []
        for j in range(features):
            s = seed * 1_000_003 + i * 100_003 + j
            u = F.rand(s)
            draws.append(F.randn(s) if method == "gaussian" else u if method == "unit" else u * (bounds[j][1] - bounds[j][0]) + bounds[j][0])
        one = spark.range(0, rows, 1, 1).select(F.lit(name).alias("anchor_set"), F.col("id").alias("anchor_id"), F.array(*draws).alias("features"))
        out = one if out is None else out.union(one)
    return out


def ranges_of(rows: DataFrame) -> DataFrame:
    """(feature, low, high) of an array of features; names sort as the places do."""
    long = rows.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return long.select(F.lpad(F.col("i").cast("string"), 8, "0").alias("feature"), "low", "high")
