"""Range operators over streams of places against static boxes; they keep no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.operators.joins import CORNERS, KEY, Levels
from loomspace.operators.search import range_filter


def stream_range_filter(stream: DataFrame, box: tuple[float, float, float, float], predicate: Column | None = None) -> DataFrame:
    """Range and text search on a stream."""
    return range_filter(stream, box, predicate)


def stream_pairs(stream: DataFrame, boxes: DataFrame, levels: Levels = Levels(), x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of arriving places and static boxes, by the same nested grids as the batch join."""
    p = levels.places(stream, levels.in_use(boxes), x, y).alias("p")
    b = levels.boxes(boxes).alias("b")
    on = G.contains(G.Box(*(F.col(f"b.{c}") for c in CORNERS)), G.Point(F.col(f"p.{x}"), F.col(f"p.{y}")))
    for k in KEY:
        on = on & (F.col(f"p.{k}") == F.col(f"b.{k}"))
    return p.join(b, on).select(*(F.col(f"p.{c}") for c in stream.columns), *(F.col(f"b.{c}") for c in boxes.columns if c not in stream.columns))
