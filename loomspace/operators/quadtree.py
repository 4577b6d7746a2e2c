"""Adaptive quadtree over a bounded sample, held as sorted Morton codes of its leaves.

The tree is small (at most ``max_leaves`` leaves), is built on the driver from a bounded sample and travels to the tasks
as two NumPy arrays. A leaf is a half-open run of Morton codes, so every place of the extent lies in exactly one leaf.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspace.operators.rtree import PackedRTree

WORLD = (-180.0, -90.0, 180.0, 90.0)
DEPTH = 15
SIDE = 1 << DEPTH


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def _gather(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64) & np.uint64(0x55555555)
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        v = (v | (v >> np.uint64(shift))) & np.uint64(mask)
    return v


@dataclass
class Quadtree:
    """``starts``: the first Morton code of each leaf, ascending; ``levels``: its depth; ``weight``: its share of the sample."""

    extent: tuple[float, float, float, float]
    starts: np.ndarray
    levels: np.ndarray
    weight: np.ndarray
    index: PackedRTree | None = field(default=None, repr=False)

    def __len__(self) -> int:
        return len(self.starts)

    def grid(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Finest column and row; places beyond the extent go to its edge cells."""
        x0, y0, x1, y1 = self.extent
        gx = np.floor((np.asarray(x, np.float64) - x0) / (x1 - x0) * SIDE)
        gy = np.floor((np.asarray(y, np.float64) - y0) / (y1 - y0) * SIDE)
        return np.clip(gx, 0, SIDE - 1).astype(np.int64), np.clip(gy, 0, SIDE - 1).astype(np.int64)

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The leaf of each place."""
        gx, gy = self.grid(x, y)
        code = _spread(gx) | (_spread(gy) << np.uint64(1))
        return np.searchsorted(self.starts, code, side="right").astype(np.int64) - 1

    def grid_boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last column and row of each leaf."""
        gx, gy = _gather(self.starts).astype(np.int64), _gather(self.starts >> np.uint64(1)).astype(np.int64)
        side = np.int64(1) << (DEPTH - self.levels)
        return gx, gy, gx + side - 1, gy + side - 1

    def cover(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf) of every rectangle and the leaves that it touches."""
        a, b = self.grid(x1, y1)
        c, d = self.grid(x2, y2)
        if self.index is None:
            self.index = PackedRTree(*self.grid_boxes())
        pairs = list(self.index.probe(a, b, c, d))
        row, leaf = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in pairs)]) for i in (0, 1))
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]

    def bounds(self) -> list[tuple[float, float, float, float]]:
        """Rectangles of the leaves in coordinates."""
        x0, y0, x1, y1 = self.extent
        lx, ly, hx, hy = self.grid_boxes()
        w, h = (x1 - x0) / SIDE, (y1 - y0) / SIDE
        return [(float(x0 + a * w), float(y0 + b * h), float(x0 + (c + 1) * w), float(y0 + (d + 1) * h)) for a, b, c, d in zip(lx, ly, hx, hy, strict=True)]


def build_quadtree(x: np.ndarray, y: np.ndarray, leaf_share: float, max_leaves: int = 4096, extent: tuple[float, float, float, float] = WORLD) -> Quadtree:
    """Split the fullest leaf until none holds more than ``leaf_share`` of the sample or ``max_leaves`` is reached."""
    one = Quadtree(extent, np.zeros(1, np.uint64), np.zeros(1, np.int64), np.ones(1))
    gx, gy = one.grid(x, y)
    codes = np.sort(_spread(gx) | (_spread(gy) << np.uint64(1)))
    n = max(1, len(codes))
    heap = [(-len(codes), 0, 0)]
    done: list[tuple[int, int, int]] = []
    while heap:
        count, start, level = heapq.heappop(heap)
        if -count <= max(1.0, leaf_share * n) or level == DEPTH or len(heap) + len(done) + 4 > max_leaves:
            done.append((start, level, -count))
            continue
        quarter = 1 << (2 * (DEPTH - level - 1))
        edges = [start + i * quarter for i in range(5)]
        at = np.searchsorted(codes, np.array(edges, np.uint64))
        for i in range(4):
            heapq.heappush(heap, (-int(at[i + 1] - at[i]), edges[i], level + 1))
    done.sort()
    return Quadtree(extent, np.array([s for s, _, _ in done], np.uint64), np.array([v for _, v, _ in done], np.int64), np.array([c / n for _, _, c in done]))


def sample_places(df: DataFrame, x: str, y: str, rows: int, size: int = 100_000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """At most about ``size`` places on the driver, whatever the table's size; ``rows`` need only be roughly right."""
    part = df.select(F.col(x).cast("float").alias("x"), F.col(y).cast("float").alias("y"))
    if rows > size:
        part = part.sample(fraction=size / rows, seed=seed)
    got = part.limit(2 * size).toPandas()
    return got["x"].to_numpy(np.float64), got["y"].to_numpy(np.float64)
