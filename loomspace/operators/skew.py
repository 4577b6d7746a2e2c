"""Skew reports and joins that divide hot cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspace.operators.joins import CORNERS, KEY, Levels, salted_pairs
from loomspace.plans.runtime import materialize


def cell_load(points: DataFrame, boxes: DataFrame, x: str = "x", y: str = "y", levels: Levels = Levels()) -> DataFrame:
    """``__level, __cx, __cy, data, queries``: how many places and boxes meet in each cell."""
    data = levels.places(points, levels.in_use(boxes), x, y).groupBy(*KEY).agg(F.count(F.lit(1)).alias("data"))
    queries = levels.boxes(boxes).groupBy(*KEY).agg(F.count(F.lit(1)).alias("queries"))
    return data.join(queries, KEY)


def hot_cells(points: DataFrame, boxes: DataFrame, ratio: float = 3.0, x: str = "x", y: str = "y", levels: Levels = Levels(), task: int = 1_000_000, most_parts: int = 4096) -> DataFrame:
    """``__level, __cx, __cy, work, parts``: the cells whose work (places times boxes) is at least ``ratio`` times the median, however many.

    A cell is divided into ``parts`` of about ``task`` tests or ``ratio`` medians each, whichever is more, and at least two.
    """
    load = materialize(cell_load(points, boxes, x, y, levels).withColumn("work", F.col("data") * F.col("queries")))
    median = load.agg(F.percentile_approx("work", 0.5).alias("m")).first()["m"] or 1
    part = max(task, ratio * median)
    return load.filter(F.col("work") >= ratio * max(1, median)).select(*KEY, "work", F.least(F.lit(most_parts), F.greatest(F.lit(2), F.ceil(F.col("work") / part))).cast("int").alias("parts"))


def optimal_cut(counts: DataFrame, data: str = "n", queries: str = "visits", overhead: float = 1.0) -> DataFrame:
    """``counts`` of the groups worth dividing, with ``parts``: the cut of lowest estimated cost.

    The groups are looked at in order of ``data * queries``, heaviest first. Dividing the first m of them so that none costs more than the
    heaviest undivided one costs its copies (``overhead`` for each query row and further part); the time is that of the heaviest
    task plus that overhead shared out over the groups. The m with the least time wins; the heaviest 1000 groups are
    candidates, which is where a cut can pay.
    """
    work = F.col(data) * F.col(queries)
    top = counts.withColumn("__w", work).orderBy(F.col("__w").desc(), *(c for c in counts.columns)).limit(1001).toPandas()
    if len(top) < 2:
        return counts.limit(0).withColumn("parts", F.lit(1))
    w, q, groups = top["__w"].to_numpy(float), top[queries].to_numpy(float), counts.count()
    copies = [float((overhead * q[:m] * (np.ceil(w[:m] / max(w[m], 1.0)) - 1)).sum()) for m in range(len(w))]
    best = int(np.argmin([w[m] + c / groups for m, c in enumerate(copies)]))
    if not best:
        return counts.limit(0).withColumn("parts", F.lit(1))
    limit = float(max(w[best], 1.0))
    return counts.filter(work > limit).withColumn("parts", F.ceil(work / limit).cast("int"))


def skew_report(counts: DataFrame, data: str = "n", queries: str | None = None, ratio: float = 3.0) -> DataFrame:
    """One row: groups, rows, the largest group, the median, and how many groups reach ``ratio`` times the median.

    With ``queries`` the groups are also measured by data times queries.
    """
    work = F.col(data) if queries is None else F.col(data) * F.col(queries)
    base = counts.withColumn("__w", work)
    median = base.agg(F.percentile_approx("__w", 0.5).alias("m")).first()["m"] or 0
    return base.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(data), F.lit(0)).cast("long").alias("rows"), F.max("__w").cast("long").alias("largest"),
        F.lit(int(median)).cast("long").alias("median"), F.coalesce(F.sum((F.col("__w") >= ratio * max(1, median)).cast("long")), F.lit(0)).cast("long").alias("hot"),
    )


def top_groups(counts: DataFrame, k: int, by: str = "n") -> DataFrame:
    """The ``k`` largest groups, ties by the other columns."""
    rest = [c for c in counts.columns if c != by]
    return counts.orderBy(F.col(by).desc(), *rest).limit(k)


def scheduled_sjoin(points: DataFrame, boxes: DataFrame, key: str = "id", ratio: float = 3.0, levels: Levels = Levels()) -> DataFrame:
    """``joins.sjoin`` with hot cells divided; the same rows."""
    places = points.select(key, "x", "y")
    hot = hot_cells(places, boxes, ratio, levels=levels)
    hit = salted_pairs(places, boxes.select(*CORNERS), hot, key, levels=levels).select(F.col(key).alias("__k"), F.col("x").alias("__x"), F.col("y").alias("__y")).distinct()
    return points.join(hit, points[key].eqNullSafe(hit["__k"]) & (points["x"] == hit["__x"]) & (points["y"] == hit["__y"]), "left_semi").dropDuplicates([key])


def scheduled_rjoin(points: DataFrame, boxes: DataFrame, box_key: str, aggregates: dict[str, Column], empty: dict[str, Column] | None = None, how: str = "left", key: str = "id", ratio: float = 3.0, levels: Levels = Levels()) -> DataFrame:
    """``joins.rjoin`` with hot cells divided; the same rows."""
    hot = hot_cells(points.select(key, "x", "y"), boxes, ratio, levels=levels)
    held = salted_pairs(points, boxes.select(box_key, *CORNERS), hot, key, levels=levels).groupBy(box_key).agg(*(a.alias(n) for n, a in aggregates.items()))
    if how == "inner":
        return held
    out = boxes.select(box_key).distinct().join(held, box_key, "left")
    for n, v in (empty or {}).items():
        out = out.withColumn(n, F.coalesce(F.col(n), v))
    return out
