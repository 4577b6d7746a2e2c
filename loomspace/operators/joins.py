"""Joins of places with boxes on a few nested grids.

A box belongs to the finest level whose cells are at least as wide and high as the box, so it touches at most four of them. A
place has one cell on each level that occurs. The join is an equi-join on level and cell with the exact test on top, which
Spark can run as any hash or merge join, split by its skew handling, and never a nested loop.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspace.functions import geometry as G

ORIGIN = (-180.0, -90.0)
CORNERS = ("x1", "y1", "x2", "y2")


class Levels:
    """Cells of side ``base * factor ** level``."""

    def __init__(self, base: float = 0.25, factor: float = 4.0, count: int = 8):
        self.sides = [base * factor**i for i in range(count)]

    def level(self, w: Column, h: Column) -> Column:
        size = F.greatest(w, h).cast("double")
        out = F.lit(len(self.sides) - 1)
        for i in range(len(self.sides) - 2, -1, -1):
            out = F.when(size <= self.sides[i], F.lit(i)).otherwise(out)
        return out

    def side(self, level: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.sides)), level)

    def cell(self, value: Column, origin: float, side: Column) -> Column:
        return F.floor((value.cast("double") - F.lit(origin)) / side)

    def boxes(self, boxes: DataFrame, grow: float = 0.0) -> DataFrame:
        """One row for each cell that a sane box touches; a box beyond the top level touches more than four."""
        finite = F.lit(True)
        for c in CORNERS:
            finite = finite & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
        sane = boxes.filter(finite & (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2")))
        level = self.level(F.col("x2") - F.col("x1") + 2 * grow, F.col("y2") - F.col("y1") + 2 * grow)
        # a box beyond the world holds no place: clipping bounds its cells
        span = lambda lo, hi, o: F.sequence(self.cell(F.greatest(F.col(lo) - grow, F.lit(-1e6)), o, F.col("__side")), self.cell(F.least(F.col(hi) + grow, F.lit(1e6)), o, F.col("__side")))
        out = sane.withColumn("__level", level).withColumn("__side", self.side(F.col("__level")))
        return out.select("*", F.explode(span("x1", "x2", ORIGIN[0])).alias("__cx")).select("*", F.explode(span("y1", "y2", ORIGIN[1])).alias("__cy")).drop("__side")

    def places(self, points: DataFrame, levels: list[int], x: str = "x", y: str = "y") -> DataFrame:
        """One row for each place and level in use; places without finite coordinates are left out."""
        cells = [F.struct(F.lit(i).alias("l"), self.cell(F.col(x), ORIGIN[0], F.lit(self.sides[i])).alias("x"), self.cell(F.col(y), ORIGIN[1], F.lit(self.sides[i])).alias("y")) for i in levels]
        out = points.filter(G.is_finite(G.Point(F.col(x), F.col(y)))).select("*", F.explode(F.array(*cells)).alias("__c"))
        return out.select(*points.columns, F.col("__c.l").alias("__level"), F.col("__c.x").alias("__cx"), F.col("__c.y").alias("__cy"))

    def in_use(self, boxes: DataFrame) -> list[int]:
        """The levels that occur, at most as many as there are sides."""
        got = boxes.select(self.level(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("l")).distinct().collect()
        return sorted(r[0] for r in got if r[0] is not None) or [0]


KEY = ["__level", "__cx", "__cy"]


def _prepared(points: DataFrame, boxes: DataFrame, levels: Levels, x: str, y: str) -> tuple[DataFrame, DataFrame, Column]:
    p = levels.places(points, levels.in_use(boxes), x, y).alias("p")
    b = levels.boxes(boxes).alias("b")
    on = F.lit(True)
    for k in KEY:
        on = on & (F.col(f"p.{k}") == F.col(f"b.{k}"))
    inside = G.contains(G.Box(*(F.col(f"b.{c}") for c in CORNERS)), G.Point(F.col(f"p.{x}"), F.col(f"p.{y}")))
    return p, b, on & inside


def rjoin_pairs(points: DataFrame, boxes: DataFrame, x: str = "x", y: str = "y", levels: Levels = Levels()) -> DataFrame:
    """All pairs of a place and a box that holds it, with the columns of both (they must not clash but for the corners)."""
    p, b, on = _prepared(points, boxes, levels, x, y)
    return p.join(b, on).select(*(F.col(f"p.{c}") for c in points.columns), *(F.col(f"b.{c}") for c in boxes.columns if c not in points.columns))


def sjoin(points: DataFrame, boxes: DataFrame, key: str = "id", x: str = "x", y: str = "y", levels: Levels = Levels(), **mapped: Column) -> DataFrame:
    """Places that at least one box holds, each key once, with ``mapped`` columns applied to the result."""
    p, b, on = _prepared(points.select(key, x, y), boxes.select(*CORNERS), levels, x, y)
    hit = p.join(b, on, "left_semi").select(F.col(f"p.{key}").alias("__k"), F.col(f"p.{x}").alias("__x"), F.col(f"p.{y}").alias("__y")).distinct()
    # the other columns stay out of the copies of a place; they are fetched by key, place by place
    out = points.join(hit, points[key].eqNullSafe(hit["__k"]) & (points[x] == hit["__x"]) & (points[y] == hit["__y"]), "left_semi").dropDuplicates([key])
    return out.withColumns(mapped) if mapped else out


def rjoin(points: DataFrame, boxes: DataFrame, box_key: str, aggregates: dict[str, Column], empty: dict[str, Column] | None = None, how: str = "left", x: str = "x", y: str = "y", levels: Levels = Levels()) -> DataFrame:
    """One row for each box: its key and aggregates over the places that it holds.

    The aggregates are combined before and after the shuffle. With ``how="left"`` a box without a place keeps a row: a value is
    NULL there unless ``empty`` gives one. ``how="inner"`` drops such boxes. Inverted boxes hold nothing.
    """
    held = rjoin_pairs(points, boxes.select(box_key, *CORNERS), x, y, levels).groupBy(box_key).agg(*(a.alias(n) for n, a in aggregates.items()))
    if how == "inner":
        return held
    return _with_empty(boxes, held, box_key, empty)


def prepare_places(points: DataFrame, boxes: DataFrame, partitions: int, x: str = "x", y: str = "y", levels: Levels = Levels()) -> DataFrame:
    """Places keyed and spread by cell for several joins; write it bucketed or persist it to use it again."""
    return levels.places(points, levels.in_use(boxes), x, y).repartition(partitions, *KEY)


def prepare_boxes(boxes: DataFrame, partitions: int, levels: Levels = Levels()) -> DataFrame:
    return levels.boxes(boxes).repartition(partitions, *KEY)


def prepared_pairs(places: DataFrame, boxes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``rjoin_pairs`` of two sides that were prepared with the same number of partitions: nothing is shuffled again."""
    p, b, on = _meeting(places, boxes, x, y)
    mine = [c for c in places.columns if c not in KEY]
    return p.join(b, on).select(*(F.col(f"p.{c}") for c in mine), *(F.col(f"b.{c}") for c in boxes.columns if c not in (*mine, *KEY)))


def _meeting(places: DataFrame, boxes: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame, Column]:
    """Two prepared sides and their join condition; equal keys and partition numbers keep both where they lie."""
    p, b = places.alias("p"), boxes.hint("shuffle_hash").alias("b")
    on = G.contains(G.Box(*(F.col(f"b.{c}") for c in CORNERS)), G.Point(F.col(f"p.{x}"), F.col(f"p.{y}")))
    for k in KEY:
        on = on & (F.col(f"p.{k}") == F.col(f"b.{k}"))
    return p, b, on


def prepared_sjoin(places: DataFrame, boxes: DataFrame, key: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """``sjoin`` of two prepared sides: only the places that are held move on, to come out once for each key."""
    p, b, on = _meeting(places, boxes, x, y)
    return p.join(b, on, "left_semi").select(*(c for c in places.columns if c not in KEY)).dropDuplicates([key])


def prepared_rjoin(places: DataFrame, boxes: DataFrame, all_boxes: DataFrame, box_key: str, aggregates: dict[str, Column], empty: dict[str, Column] | None = None, how: str = "left", x: str = "x", y: str = "y") -> DataFrame:
    """``rjoin`` of two prepared sides; only one state for each box and task moves on. ``all_boxes`` gives the keys of ``how="left"``."""
    p, b, on = _meeting(places, boxes, x, y)
    held = p.join(b, on).select(f"b.{box_key}", *(F.col(f"p.{c}") for c in places.columns if c not in KEY)).groupBy(box_key).agg(*(a.alias(n) for n, a in aggregates.items()))
    return held if how == "inner" else _with_empty(all_boxes, held, box_key, empty)


def _with_empty(boxes: DataFrame, held: DataFrame, box_key: str, empty: dict[str, Column] | None) -> DataFrame:
    out = boxes.select(box_key).distinct().join(held, box_key, "left")
    return out.withColumns({n: F.coalesce(F.col(n), v) for n, v in (empty or {}).items()})


def rjoin_custom(points: DataFrame, boxes: DataFrame, box_key: str, partial: Callable[[pd.DataFrame], object], merge: Callable[[object, object], object], kind: str, empty: object = None, key: str = "id", parts: int = 16, x: str = "x", y: str = "y", levels: Levels = Levels()) -> DataFrame:
    """``box_key, value`` with an aggregate of one's own: ``partial`` over some of a box's places, ``merge`` of two such values.

    Each box's places are divided by a hash of ``key`` into ``parts``, so no task gets all places of a box that holds a third of
    them; only one value a part is shuffled on. Boxes without a place get ``empty``. Use ``rjoin`` where native aggregates suffice.
    """
    pairs = rjoin_pairs(points, boxes.select(box_key, *CORNERS), x, y, levels).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    schema = f"{box_key} {boxes.schema[box_key].dataType.simpleString()}, value {kind}"

    def first(at: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({box_key: [at[0]], "value": [partial(rows.drop(columns="__part"))]})

    def last(at: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({box_key: [at[0]], "value": [reduce(merge, rows["value"].tolist())]})

    held = pairs.groupBy(box_key, "__part").applyInPandas(first, schema).groupBy(box_key).applyInPandas(last, schema)
    return boxes.select(box_key).distinct().join(held, box_key, "left").withColumn("value", F.coalesce("value", F.lit(empty).cast(kind)))


def salted_pairs(points: DataFrame, boxes: DataFrame, hot: DataFrame, key: str = "id", x: str = "x", y: str = "y", levels: Levels = Levels()) -> DataFrame:
    """``rjoin_pairs`` with the ``hot`` cells (``__level, __cx, __cy, parts``) divided: their places by a hash of the key into so many
    parts, their boxes copied to each part. Spark's own size estimate of ``hot`` decides whether it is broadcast."""
    p = levels.places(points, levels.in_use(boxes), x, y)
    b = levels.boxes(boxes)
    mark = hot.select(*KEY, F.col("parts").alias("__hot"))
    p = p.join(mark, KEY, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(key), F.col("__hot")), F.lit(0)).cast("int")).drop("__hot").alias("p")
    b = b.join(mark, KEY, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__hot"), F.lit(1)) - 1))).drop("__hot").alias("b")
    on = G.contains(G.Box(*(F.col(f"b.{c}") for c in CORNERS)), G.Point(F.col(f"p.{x}"), F.col(f"p.{y}")))
    for k in [*KEY, "__salt"]:
        on = on & (F.col(f"p.{k}") == F.col(f"b.{k}"))
    return p.join(b, on).select(*(F.col(f"p.{c}") for c in points.columns), *(F.col(f"b.{c}") for c in boxes.columns if c not in points.columns))


def suggested_base(mean_side: float) -> float:
    """A base side for boxes of a given mean side: the next power of two below it, within sensible bounds."""
    return min(16.0, max(2.0**-10, 2.0 ** math.floor(math.log2(mean_side)))) if mean_side > 0 else 0.25
