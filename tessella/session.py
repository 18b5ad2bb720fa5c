"""Session helpers: tables of a data folder, and cutting a lineage where later steps must see the same rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a local master may do without one and gets a temporary folder."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessella-"))
    return context._jsc.sc().getCheckpointDir().get()


def stable(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into that folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, replaces: str | None = None) -> tuple[DataFrame, str]:
    """(the rows from a file in that folder, its path); ``replaces`` is a path that nothing reads any more.

    For loops of joins: a checkpoint keeps the estimate of its size, which each round's joins would multiply, and a file has its own.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(replaces)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(df.schema).parquet(path), path
