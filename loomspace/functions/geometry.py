"""Scalar geometry as column expressions, all inside code generation.

Coordinates are single precision. Differences are taken in single precision and widened before they are squared, so results
are bit-identical however a plan is split. Contains and intersects are closed, wraps is open; inverted boxes match nothing by
themselves. NULL in any coordinate gives NULL.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Point(NamedTuple):
    x: Column
    y: Column


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def _float(c: str | float | Column) -> Column:
    return F.col(c).cast("float") if isinstance(c, str) else c.cast("float") if isinstance(c, Column) else F.lit(float(c)).cast("float")


def point(x: str | float | Column = "x", y: str | float | Column = "y") -> Point:
    """From column names, numbers or columns."""
    return Point(_float(x), _float(y))


def box(x1: str | float | Column = "x1", y1: str | float | Column = "y1", x2: str | float | Column = "x2", y2: str | float | Column = "y2") -> Box:
    return Box(_float(x1), _float(y1), _float(x2), _float(y2))


def to_box(p: Point) -> Box:
    return Box(p.x, p.y, p.x, p.y)


def lower_left(b: Box) -> Point:
    return Point(b.x1, b.y1)


def upper_right(b: Box) -> Point:
    return Point(b.x2, b.y2)


def as_struct(g: Point | Box) -> Column:
    return F.struct(*(c.alias(n) for n, c in g._asdict().items()))


def normalize(b: Box) -> Box:
    """Corners in order; the only function that repairs an inverted box."""
    return Box(F.least(b.x1, b.x2), F.least(b.y1, b.y2), F.greatest(b.x1, b.x2), F.greatest(b.y1, b.y2))


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def area(b: Box) -> Column:
    return width(b) * height(b)


def is_finite(g: Point | Box) -> Column:
    """False for NULL, NaN and infinities."""
    out = F.lit(True)
    for c in g:
        out = out & F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")), F.lit(False))
    return out


def contains(b: Box, g: Point | Box) -> Column:
    """Closed on all sides; a conjunction of comparisons that reaches the Parquet reader for literal boxes."""
    lo, hi = (g, g) if isinstance(g, Point) else (lower_left(g), upper_right(g))
    return (lo.x >= b.x1) & (hi.x <= b.x2) & (lo.y >= b.y1) & (hi.y <= b.y2)


def equals(a: Point | Box, b: Point | Box) -> Column:
    out = F.lit(True)
    for p, q in zip(a if isinstance(a, Box) else to_box(a), b if isinstance(b, Box) else to_box(b), strict=True):
        out = out & (p == q)
    return out


def intersects(a: Box, b: Box) -> Column:
    """Closed: touching counts."""
    return (a.x1 <= b.x2) & (b.x1 <= a.x2) & (a.y1 <= b.y2) & (b.y1 <= a.y2)


def wraps(b: Box, g: Point | Box) -> Column:
    """Open: the other lies strictly inside."""
    lo, hi = (g, g) if isinstance(g, Point) else (lower_left(g), upper_right(g))
    return (lo.x > b.x1) & (hi.x < b.x2) & (lo.y > b.y1) & (hi.y < b.y2)


inside_box = wraps


def expand(a: Box, b: Box) -> Box:
    """Least box around both."""
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def expand_area(a: Box, b: Box) -> Column:
    """By how much the area grows when ``a`` is expanded by ``b``."""
    return area(expand(a, b)) - area(a)


def intersect_box(a: Box, b: Box) -> Box:
    """Inverted if the two are disjoint."""
    return Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))


def intersection_area(a: Box, b: Box) -> Column:
    i, zero = intersect_box(a, b), F.lit(0).cast("float")
    return F.greatest(zero, width(i)) * F.greatest(zero, height(i))


def area_ratio(a: Box, b: Box) -> Column:
    """Share of ``b`` that ``a`` covers; NULL for an empty ``b``."""
    return F.when(area(b) > 0, intersection_area(a, b).cast("double") / area(b).cast("double"))


def less(a: Point, b: Point) -> Column:
    """Both coordinates smaller."""
    return (a.x < b.x) & (a.y < b.y)


def distance_squared(g: Point | Box, p: Point) -> Column:
    """Double; to the nearest edge of a box, 0 inside."""
    if isinstance(g, Point):
        dx, dy = (g.x - p.x).cast("double"), (g.y - p.y).cast("double")
    else:
        zero = F.lit(0).cast("float")
        dx = F.when(p.x < g.x1, g.x1 - p.x).when(p.x <= g.x2, zero).otherwise(p.x - g.x2).cast("double")
        dy = F.when(p.y < g.y1, g.y1 - p.y).when(p.y <= g.y2, zero).otherwise(p.y - g.y2).cast("double")
    return dx * dx + dy * dy


def distance(g: Point | Box, p: Point) -> Column:
    return F.sqrt(distance_squared(g, p))


def edge_gap(a: Box, b: Box) -> Column:
    """0 if the boxes meet, else the least of the four absolute gaps between facing edges (not a Euclidean distance)."""
    gaps = F.least(F.abs(a.x1 - b.x2), F.abs(b.x1 - a.x2), F.abs(a.y1 - b.y2), F.abs(b.y1 - a.y2))
    return F.when(intersects(a, b), F.lit(0).cast("float")).otherwise(gaps)


def box_distance(a: Box, b: Box) -> Column:
    """Euclidean distance of two boxes, double."""
    zero = F.lit(0).cast("float")
    dx, dy = F.greatest(a.x1 - b.x2, b.x1 - a.x2, zero).cast("double"), F.greatest(a.y1 - b.y2, b.y1 - a.y2, zero).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def geometry_hash(g: Point | Box) -> Column:
    return F.xxhash64(*g)


def mentions(text: Column, folded: list[str], raw: list[str] = []) -> Column:
    """Any of ``folded`` in the lower-cased text, or any of ``raw`` in the text as it stands."""
    out = F.lit(False)
    for t in folded:
        out = out | F.lower(text).contains(t)
    for t in raw:
        out = out | text.contains(t)
    return out


def mbr(x: str | Column = "x", y: str | Column = "y") -> list[Column]:
    """Aggregates ``x1, y1, x2, y2`` of the bounding box; NULL over no rows."""
    return [F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x).alias("x2"), F.max(y).alias("y2")]
