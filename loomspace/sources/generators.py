"""Random places and rectangles, made in parallel and the same for the same seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_points(spark: SparkSession, n: int, width: float, height: float, x0: float = 0.0, y0: float = 0.0, seed: int = 1) -> DataFrame:
    """``id, x, y``: whole-numbered places in a rectangle."""
    ids = spark.range(n)
    return ids.select("id", (F.floor(F.rand(seed) * width) + x0).cast("float").alias("x"), (F.floor(F.rand(seed + 1) * height) + y0).cast("float").alias("y"))


def gaussian_points(spark: SparkSession, n: int, mean: tuple[float, float] = (0.0, 0.0), covariance: tuple[float, float, float] = (1000.0, 1.5, 3000.0), seed: int = 1) -> DataFrame:
    """``id, x, y``: normal places; ``covariance`` gives xx, xy and yy."""
    xx, xy, yy = covariance
    a = math.sqrt(xx)
    b = xy / a
    c = math.sqrt(yy - b * b)
    u, v = F.randn(seed), F.randn(seed + 1)
    return spark.range(n).select("id", u.alias("u"), v.alias("v")).select("id", (F.col("u") * a + mean[0]).cast("float").alias("x"), (F.col("u") * b + F.col("v") * c + mean[1]).cast("float").alias("y"))


def random_boxes(spark: SparkSession, n: int, width: float, height: float, most_side: float, seed: int = 1) -> DataFrame:
    """``bid, x1, y1, x2, y2``: a uniform corner and a side below ``most_side`` along each axis."""
    r = lambda i, m: F.rand(seed + i) * m
    base = spark.range(n).select(F.col("id").alias("bid"), r(0, width).cast("float").alias("x1"), r(1, height).cast("float").alias("y1"), r(2, most_side).alias("w"), r(3, most_side).alias("h"))
    return base.select("bid", "x1", "y1", (F.col("x1") + F.col("w")).cast("float").alias("x2"), (F.col("y1") + F.col("h")).cast("float").alias("y2"))
