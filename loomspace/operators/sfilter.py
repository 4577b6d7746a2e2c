"""A filter of occupied cells: says for a box that it certainly holds no place, or that it may hold some.

There are no false negatives: a box that does hold a place is always let through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.operators.grid import Grid


def train(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """The occupied cells ``cx, cy``; bounded by the grid's shape."""
    return grid.place(points.filter(G.is_finite(G.Point(F.col(x), F.col(y)))), x, y).select("cx", "cy").distinct()


def mark_empty(cells: DataFrame, grid: Grid, box: tuple[float, float, float, float]) -> DataFrame:
    """Without the cells that lie wholly inside a box known to be empty."""
    x0, y0 = grid.extent[:2]
    left, low = F.col("cx") * grid.side + x0, F.col("cy") * grid.side + y0
    inside = (left >= box[0]) & (left + grid.side <= box[2]) & (low >= box[1]) & (low + grid.side <= box[3])
    return cells.filter(~inside)


def may_contain(boxes: DataFrame, cells: DataFrame, grid: Grid, key: str) -> DataFrame:
    """The boxes that touch an occupied cell, each key once."""
    touched = grid.cover(boxes).join(cells, ["cx", "cy"], "left_semi").select(*boxes.columns)
    return touched.dropDuplicates([key])


def empty_fraction(boxes: DataFrame, cells: DataFrame, grid: Grid, key: str) -> DataFrame:
    """``key, fraction``: the share of each box's area that lies in empty cells; NULL for a box without area.

    What lies beyond the extent belongs to no cell and counts as empty.
    """
    x0, y0 = grid.extent[:2]
    side = F.lit(float(grid.side))
    left, low = F.col("cx") * side + x0, F.col("cy") * side + y0
    d = lambda c: F.col(c).cast("double")
    part = F.greatest(F.lit(0.0), F.least(d("x2"), left + side) - F.greatest(d("x1"), left)) * F.greatest(F.lit(0.0), F.least(d("y2"), low + side) - F.greatest(d("y1"), low))
    covered = grid.cover(boxes).join(cells, ["cx", "cy"]).groupBy(key).agg(F.sum(part).alias("__full"))
    area = (d("x2") - d("x1")) * (d("y2") - d("y1"))
    return boxes.dropDuplicates([key]).join(covered, key, "left").select(key, F.when(area > 0, 1 - F.coalesce("__full", F.lit(0.0)) / area).alias("fraction"))


def mostly_empty(boxes: DataFrame, cells: DataFrame, grid: Grid, key: str, threshold: float) -> DataFrame:
    """The boxes of which at least ``threshold`` is empty."""
    return empty_fraction(boxes, cells, grid, key).filter(F.col("fraction") >= threshold)


def coarsen(cells: DataFrame, factor: int = 2) -> DataFrame:
    """The same filter over cells ``factor`` times as wide: fewer cells, more boxes let through."""
    return cells.select(F.floor(F.col("cx") / factor).cast("int").alias("cx"), F.floor(F.col("cy") / factor).cast("int").alias("cy")).distinct()


def encode(cells: DataFrame, grid: Grid) -> DataFrame:
    """``bucket, bits``: the filter as bitmaps of 32,768 cells each."""
    number = (F.col("cy").cast("long") * grid.shape[0] + F.col("cx") + 1).alias("n")
    rows = cells.select(number)
    return rows.groupBy(F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def may_contain_encoded(boxes: DataFrame, encoded: DataFrame, grid: Grid, key: str, most_bytes: int = 32 << 20) -> DataFrame:
    """``may_contain`` out of the bitmaps alone: the boxes with a cell whose bit is set, each key once.

    The bitmaps hold one bit for each cell of the grid, so their size is known beforehand; up to ``most_bytes`` they are broadcast.
    """
    small = F.broadcast(encoded) if grid.shape[0] * grid.shape[1] // 8 <= most_bytes else encoded
    n = F.col("cy").cast("long") * grid.shape[0] + F.col("cx") + 1
    at = grid.cover(boxes).select("*", F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("__at"))
    return at.join(small, "bucket").filter(_bit(F.col("bits"), F.col("__at"))).select(*boxes.columns).dropDuplicates([key])


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def decode(encoded: DataFrame, grid: Grid) -> DataFrame:
    """The occupied cells ``cx, cy`` of an encoded filter."""
    places = encoded.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.octet_length("bits") * 8 - 1)).alias("__at")).filter(_bit(F.col("bits"), F.col("__at")))
    n = (F.col("bucket") - 1) * 32768 + F.col("__at")
    return places.select((n % grid.shape[0]).cast("int").alias("cx"), F.floor(n / grid.shape[0]).cast("int").alias("cy"))


def encoded_count(encoded: DataFrame) -> DataFrame:
    """``n``: occupied cells of an encoded filter."""
    return encoded.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
