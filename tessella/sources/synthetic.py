"""Generated tables: Gaussian clusters, rings, and random anchor images. Columns x1 .. xd and target; seeded."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gaussians(spark: SparkSession, n: int, means: Sequence[Sequence[float]], covariances: Sequence[Sequence[Sequence[float]]] | float = 1.0, seed: int = 0) -> DataFrame:
    """n rows, dealt to the clusters in turn; each is its mean plus a Cholesky factor times standard normals."""
    d = len(means[0])
    factors = [np.linalg.cholesky(np.array(c, float)) for c in covariances] if not isinstance(covariances, float | int) else [np.eye(d) * math.sqrt(covariances)] * len(means)
    rows = spark.range(n).select((F.col("id") % len(means)).cast("int").alias("target"), *[F.randn(seed * 1009 + j).alias(f"e{j}") for j in range(d)])
    table = F.lit([[[float(v) for v in line] for line in f] for f in factors])
    centre = F.lit([[float(v) for v in m] for m in means])
    at = F.col("target")
    return rows.select(*[(centre[at][i] + sum((table[at][i][j] * F.col(f"e{j}") for j in range(d)), F.lit(0.0))).alias(f"x{i + 1}") for i in range(d)], "target")


def two_gaussians(spark: SparkSession, n: int = 500, distance: float = 3.0, seed: int = 0) -> DataFrame:
    return gaussians(spark, n, [(0.0, 0.0), (distance, distance)], 1.0, seed)


def cube_gaussians(spark: SparkSession, n: int = 8000, side: float = 4.0, spread: float = 0.5, seed: int = 0) -> DataFrame:
    """Eight clusters at the corners of a cube."""
    return gaussians(spark, n, [(x, y, z) for x in (0.0, side) for y in (0.0, side) for z in (0.0, side)], spread, seed)


def slanted_gaussians(spark: SparkSession, n: int = 600, seed: int = 0) -> DataFrame:
    """Three stretched clusters in space that differ in place and in direction."""
    lean = lambda r: [[1.0, r, 0.0], [r, 1.0, 0.0], [0.0, 0.0, 0.3]]
    return gaussians(spark, n, [(0.0, 0.0, 0.0), (3.0, 0.0, 1.0), (0.0, 3.0, 2.0)], [lean(0.8), lean(-0.8), lean(0.0)], seed)


def rings(spark: SparkSession, n: int = 500, radii: Sequence[float] = (1.0, 2.0), noise: float = 0.1, seed: int = 0) -> DataFrame:
    angle = F.rand(seed) * (2 * math.pi)
    radius = F.lit([float(r) for r in radii])[F.col("target")] + F.randn(seed + 1) * noise
    rows = spark.range(n).select((F.col("id") % len(radii)).cast("int").alias("target")).withColumn("a", angle).withColumn("r", radius)
    return rows.select((F.col("r") * F.cos("a")).alias("x1"), (F.col("r") * F.sin("a")).alias("x2"), "target")


def random_images(institutions: int, rows: int, width: int, seed: int = 0, binary: bool = False) -> dict[int, np.ndarray]:
    """Unrelated anchor images, the hardest case for an alignment."""
    rng = np.random.default_rng(seed)
    return {k: rng.integers(0, 2, (rows, width)).astype(float) if binary else rng.normal(size=(rows, width)) for k in range(institutions)}


def related_images(institutions: int, rows: int, width: int, seed: int = 0, gamma: float = 0.1) -> dict[int, np.ndarray]:
    """Kernel images of the same random anchors, each rotated by its institution."""
    from ..functions.linalg import kernel_pca, random_orthogonal

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, width))
    base = kernel_pca(x, width, gamma)(x)
    return {k: base @ random_orthogonal(width, rng) for k in range(institutions)}
