"""Uniform grids: cells of places, cells of boxes, partition numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORLD = (-180.0, -90.0, 180.0, 90.0)


@dataclass(frozen=True)
class Grid:
    """Half-open cells of the given side; places beyond the extent belong to the edge cells."""

    side: float
    extent: tuple[float, float, float, float] = WORLD

    @property
    def shape(self) -> tuple[int, int]:
        x0, y0, x1, y1 = self.extent
        return max(1, -int(-(x1 - x0) // self.side)), max(1, -int(-(y1 - y0) // self.side))

    def column(self, x: str | Column) -> Column:
        return self._at(x, self.extent[0], self.shape[0])

    def row(self, y: str | Column) -> Column:
        return self._at(y, self.extent[1], self.shape[1])

    def _at(self, c: str | Column, low: float, n: int) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return F.least(F.greatest(F.floor((c.cast("double") - F.lit(low)) / F.lit(float(self.side))), F.lit(0)), F.lit(n - 1)).cast("int")

    def place(self, df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """With the cell of each place: ``cx, cy``."""
        return df.withColumns({"cx": self.column(x), "cy": self.row(y)})

    def cover(self, df: DataFrame, columns: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), outer: bool = False) -> DataFrame:
        """One row for each cell that a box touches. Inverted boxes, and those with a NULL or NaN corner, touch none; with
        ``outer`` they keep one row with NULL cells."""
        x1, y1, x2, y2 = columns
        sane = (F.col(x1) <= F.col(x2)) & (F.col(y1) <= F.col(y2)) & ~F.isnan(F.col(x2).cast("double")) & ~F.isnan(F.col(y2).cast("double"))
        explode = F.explode_outer if outer else F.explode
        xs = F.when(sane, F.sequence(self.column(x1), self.column(x2)))
        ys = F.when(sane, F.sequence(self.row(y1), self.row(y2)))
        return df.select("*", explode(xs).alias("cx")).select("*", explode(ys).alias("cy"))

    def partition(self, cx: str | Column, cy: str | Column, n: int) -> Column:
        """Partition number of a cell."""
        c = lambda v: F.col(v) if isinstance(v, str) else v
        return ((c(cy) * F.lit(self.shape[0]) + c(cx)) % F.lit(n)).cast("int")


def square_grid(partitions: int, extent: tuple[float, float, float, float] = WORLD) -> Grid:
    """About ``partitions`` cells over the extent."""
    x0, y0, x1, y1 = extent
    return Grid(((x1 - x0) * (y1 - y0) / partitions) ** 0.5, extent)


def cell_counts(df: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    return grid.place(df, x, y).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


def partition_counts(df: DataFrame, grid: Grid, partitions: int, x: str = "x", y: str = "y") -> DataFrame:
    placed = grid.place(df, x, y)
    return placed.groupBy(grid.partition("cx", "cy", partitions).alias("pid")).agg(F.count(F.lit(1)).alias("n"))


def physical_partition_counts(df: DataFrame) -> DataFrame:
    """Rows of each of the DataFrame's partitions as they lie."""
    return df.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"))
