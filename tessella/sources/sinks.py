"""Where results go: append-only tables whose schema widens, long tables of representations, single-folder CSV."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def append_log(df: DataFrame, path: str) -> None:
    """Append rows; new columns widen the table."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows under the union of all columns; a column that a row did not have is null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a log has been written there, in whatever store the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_split(train: DataFrame, test: DataFrame, path: str) -> None:
    train.write.mode("overwrite").parquet(f"{path}/train")
    test.write.mode("overwrite").parquet(f"{path}/test")


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test")


def representation_table(df: DataFrame) -> DataFrame:
    """(dim_1 .. dim_n, y, data_type, institution) from the long table's arrays."""
    from pyspark.sql import functions as F

    width = df.agg(F.max(F.size("features"))).first()[0] or 0
    return df.select(*[F.get("features", F.lit(i)).alias(f"dim_{i + 1}") for i in range(width)], F.col("target").alias("y"), F.col("part").alias("data_type"), "institution")


def timed(action: Callable, path: str, spark: SparkSession, **told) -> object:
    """Run an action and append (func, elapsed_ms, ...) to a log."""
    began = time.perf_counter()
    out = action()
    row = {"func": getattr(action, "__name__", "action"), "elapsed_ms": (time.perf_counter() - began) * 1000, **told}
    append_log(spark.createDataFrame([tuple(row.values())], list(row)), path)
    return out
