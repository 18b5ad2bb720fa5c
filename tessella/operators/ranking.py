"""A total order over rows without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """0-based place of each row in the order: range partitions are numbered locally and shifted by the counts before them.

    The range-partitioned rows are checkpointed, since their partitions are drawn from a sample and must not change
    between counting and numbering. The driver sees one count per partition.
    """
    cut = stable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["count"] for r in cut.groupBy("__part").count().collect()}
    before, n = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(n)
        n += counts.get(p, 0)
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return cut.withColumn(name, (F.lit(before or [0])[F.col("__part")] + local).cast("long")).drop("__part")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per group, the first in the order. Partial aggregates on a struct: no group is sorted or gathered."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [F.col(o) if isinstance(o, str) else o for o in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ranked)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)
