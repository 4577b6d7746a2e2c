"""k-means over places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.plans.runtime import ship


def assign(points: DataFrame, centres: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """With ``cluster`` (equal distances: the smaller number) and ``d2``; the centres travel as literals, so their number must be modest."""
    p = G.Point(F.col(x), F.col(y))
    each = [F.struct(G.distance_squared(p, G.point(a, b)).alias("d2"), F.lit(i).cast("long").alias("cluster")) for i, (a, b) in enumerate(centres)]
    best = F.array_min(F.array(*each))
    return points.filter(G.is_finite(p)).withColumn("__b", best).withColumns({"cluster": F.col("__b.cluster"), "d2": F.col("__b.d2")}).drop("__b")


def lloyd_step(points: DataFrame, centres: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """``cluster, n, x, y, d2``: members, new centre and squared distances to the old one; empty clusters have no row."""
    d = lambda c: F.col(c).cast("double")
    return assign(points, centres, x, y).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(d(x)).alias("x"), F.avg(d(y)).alias("y"), F.sum("d2").alias("d2"))


def _sums(points: DataFrame, centres: np.ndarray, x: str, y: str) -> pd.DataFrame:
    """``set, cluster, n, x, y, d2`` for several sets of centres at once: members, sums of their places and of their squared distances."""
    sets, k = centres.shape[:2]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((sets, k, 4))
        for b in batches:
            px, py = b[x].to_numpy(np.float64), b[y].to_numpy(np.float64)
            for s in range(sets):
                d2, own = np.full(len(px), np.inf), np.zeros(len(px), np.int64)
                for c in range(k):
                    d = (px - centres[s, c, 0]) ** 2 + (py - centres[s, c, 1]) ** 2
                    near = d < d2
                    own[near] = c
                    np.minimum(d2, d, out=d2)
                out[s] += np.stack([np.bincount(own, w, k) for w in (None, px, py, d2)], axis=1)
        at = np.indices((sets, k)).reshape(2, -1)
        yield pd.DataFrame({"set": at[0], "cluster": at[1]} | dict(zip(("n", "x", "y", "d2"), out.reshape(-1, 4).T, strict=True)))

    names = ["n", "x", "y", "d2"]
    return points.mapInPandas(fold, "set long, cluster long, n double, x double, y double, d2 double").groupBy("set", "cluster").agg(*(F.sum(c).alias(c) for c in names)).toPandas()


def kmeans(points: DataFrame, k: int, restarts: int = 25, tolerance: float = 1e-4, most: int = 100, seed: int = 1, x: str = "x", y: str = "y") -> tuple[float, list[tuple[float, float]]]:
    """Dispersion (sum of squared distances) and centres of the best of several random starts.

    A start ends once a step changes its dispersion by at most ``tolerance``, or after ``most`` steps. All starts that still move
    take a step in one pass over the places; only ``k`` rows a start come to the driver. Starts are ``k`` rows drawn at random; a
    cluster that runs empty keeps its centre.
    """
    ship(points.sparkSession)
    p = points.filter(G.is_finite(G.Point(F.col(x), F.col(y)))).select(x, y).persist()
    try:
        starts = [p.orderBy(F.rand(seed + n)).limit(k).collect() for n in range(restarts)]
        if not starts or not starts[0]:
            return 0.0, []
        centres = np.array(starts, np.float64)
        before, going = np.full(restarts, np.inf), np.arange(restarts)
        for _ in range(most):
            rows = _sums(p, centres[going], x, y)
            at, now = going[rows["set"].to_numpy()], np.zeros(restarts)
            np.add.at(now, at, rows["d2"].to_numpy())
            full = rows["n"].to_numpy() > 0
            centres[at[full], rows["cluster"].to_numpy()[full]] = (rows[["x", "y"]].to_numpy() / rows[["n"]].to_numpy())[full]
            moving = np.abs(before[going] - now[going]) > tolerance
            before[going] = now[going]
            going = going[moving]
            if not len(going):
                break
        best = int(before.argmin())
        return float(before[best]), [(float(a), float(b)) for a, b in centres[best]]
    finally:
        p.unpersist()


def ml_kmeans(points: DataFrame, k: int, seed: int = 1, x: str = "x", y: str = "y") -> DataFrame:
    """With ``cluster`` from Spark's own k-means (random start, tolerance 1e-4, at most 100 steps)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    kept = points.filter(G.is_finite(G.Point(F.col(x), F.col(y))))
    rows = VectorAssembler(inputCols=[x, y], outputCol="__v").transform(kept)
    model = KMeans(k=k, seed=seed, initMode="random", tol=1e-4, maxIter=100, featuresCol="__v", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("__v")
