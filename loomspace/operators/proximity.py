"""Joins of places with regions and with other places.

A quadtree over a bounded sample of the objects divides the plane into leaves of about ``target`` objects. Each object goes
to one leaf (its own, or for the intersection of two rectangles to every leaf it touches), each region to all leaves that
it touches. A leaf that stays too full because many objects share one spot, or that many regions touch, is divided further by hashes of
either side's ids, so that no task gets an unbounded group (see ``Parts``). Each part bulk-loads an R-tree over its
regions, probes it in batches and tests the exact predicate. A pair is kept only in the leaf that holds its reference
point, hence once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspace.operators.quadtree import Quadtree, build_quadtree, sample_places
from loomspace.operators.rtree import PackedRTree
from loomspace.plans.runtime import ship

FIELDS = ["id", "x1", "y1", "x2", "y2"]


class Parts:
    """Groups of a quadtree's leaves: a leaf with many objects or many regions is a grid of hash parts of either side.

    A group has about ``target`` objects and ``most_regions`` regions. An object goes to one part of its side, once for each part of the
    regions' side, and the other way round, so every pair of a leaf meets in exactly one group.
    """

    def __init__(self, objects: np.ndarray, regions: np.ndarray, target: int, most_regions: int):
        self.objects = np.maximum(1, np.ceil(objects / target)).astype(np.int64)
        self.regions = np.maximum(1, np.ceil(regions / most_regions)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.objects * self.regions)]).astype(np.int64)

    def of(self, leaf: np.ndarray, hashed: np.ndarray, region: bool) -> tuple[np.ndarray, np.ndarray]:
        """Row and group of each copy of regions, or of objects, at the given leaves."""
        own, other = (self.regions[leaf], self.objects[leaf]) if region else (self.objects[leaf], self.regions[leaf])
        row = np.repeat(np.arange(len(leaf)), other)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(other) - other, other)
        mine, at = (hashed % own)[row], leaf[row]
        region_part, object_part = (mine, rank) if region else (rank, mine)
        return row, self.first[at] + region_part * self.objects[at] + object_part

    def leaf(self, group: int) -> int:
        return int(np.searchsorted(self.first, group, side="right")) - 1


def region_join(
    left: DataFrame, right: DataFrame, predicate: str, distance: float = 0.0, rows: int | None = None,
    target: int = 32_768, max_leaves: int = 16_384, sample_size: int = 100_000, most_regions: int = 8_192,
) -> DataFrame:
    """Pairs ``left_id, right_id`` of regions (left) and objects (right), both given as ``id, x1, y1, x2, y2``.

    ``predicate``: ``contains`` (the object lies in the region as a whole, edges included), ``intersects`` (they touch),
    or ``within`` (the lower-left corners are at most ``distance`` apart, limit included). All tests are exact in double
    precision on the given coordinates.

    Rows with a NULL or NaN in any of the five columns and rectangles with x1 > x2 or y1 > y2 match nothing; repeated rows count
    once; an empty side gives no pairs; further columns are ignored. ``rows``: roughly the objects' number, counted if None.
    """
    if predicate not in ("contains", "intersects", "within"):
        raise ValueError(f"unknown predicate {predicate}")
    spark = ship(left.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        ok = F.col("id").isNotNull() & (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2"))
        for c in FIELDS[1:]:
            ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        return df.select(*FIELDS).filter(ok)

    left, right = clean(left), clean(right)
    if rows is None:
        rows = right.count()
    tree = build_quadtree(*sample_places(right, "x1", "y1", rows, sample_size), leaf_share=target / max(1, rows), max_leaves=max_leaves)
    reach = distance * (1 + 1e-9) + 1e-12 if predicate == "within" else 0.0
    asked = left.count()
    some = left.sample(fraction=20_000 / asked, seed=11) if asked > 20_000 else left
    drawn = some.limit(40_000).toPandas()[FIELDS[1:]].to_numpy(np.float64)
    visited = tree.cover(*(drawn + np.array([-reach, -reach, reach, reach])).T)[1]
    shared = spark.sparkContext.broadcast((tree, Parts(tree.weight * rows, np.bincount(visited, minlength=len(tree)) * (asked / max(1, len(drawn))), target, most_regions)))  # a few numbers for each leaf
    divided = bool((shared.value[1].regions > 1).any())

    @F.pandas_udf(T.LongType())
    def object_group(x: pd.Series, y: pd.Series, h: pd.Series) -> pd.Series:
        tree, parts = shared.value
        leaf = tree.leaf(x.to_numpy(), y.to_numpy())
        return pd.Series(parts.first[leaf] + h.to_numpy() % parts.objects[leaf])

    def covered(batches: Iterator[pd.DataFrame], region: bool, grow: float, own_leaf: bool = False) -> Iterator[pd.DataFrame]:
        tree, parts = shared.value
        for b in batches:
            x1, y1, x2, y2 = (b[c].to_numpy(np.float64) for c in FIELDS[1:])
            row, leaf = (np.arange(len(b)), tree.leaf(x1, y1)) if own_leaf else tree.cover(x1 - grow, y1 - grow, x2 + grow, y2 + grow)
            copy, group = parts.of(leaf, b["__h"].to_numpy()[row], region)
            yield b[FIELDS].iloc[row[copy]].assign(part=group)

    hashed = lambda df: df.withColumn("__h", F.pmod(F.xxhash64("id"), F.lit(1 << 31)))
    schema = lambda df: T.StructType([*df.schema.fields, T.StructField("part", T.LongType())])
    regions = hashed(left).mapInPandas(lambda it: covered(it, True, reach), schema(left))
    if predicate == "intersects" or divided:
        objects = hashed(right).mapInPandas(lambda it: covered(it, False, 0.0, predicate != "intersects"), schema(right))
    else:
        objects = hashed(right).withColumn("part", object_group("x1", "y1", "__h")).drop("__h")

    def probe(lefts: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:
        out_l, out_r = [lefts["id"].to_numpy()[:0]], [rights["id"].to_numpy()[:0]]
        if len(lefts) and len(rights):
            tree, parts = shared.value
            here = parts.leaf(int(lefts["part"].iloc[0]))
            lefts, rights = lefts.drop_duplicates(), rights.drop_duplicates()
            lx1, ly1, lx2, ly2 = (lefts[c].to_numpy(np.float64) for c in FIELDS[1:])
            rx1, ry1, rx2, ry2 = (rights[c].to_numpy(np.float64) for c in FIELDS[1:])
            lid, rid = lefts["id"].to_numpy(), rights["id"].to_numpy()
            index = PackedRTree(lx1 - reach, ly1 - reach, lx2 + reach, ly2 + reach)
            for r, q in index.probe(rx1, ry1, rx2, ry2):
                if predicate == "contains":
                    ok = (lx1[q] <= rx1[r]) & (rx2[r] <= lx2[q]) & (ly1[q] <= ry1[r]) & (ry2[r] <= ly2[q])
                elif predicate == "within":
                    ok = (lx1[q] - rx1[r]) ** 2 + (ly1[q] - ry1[r]) ** 2 <= distance * distance
                else:
                    ok = tree.leaf(np.maximum(lx1[q], rx1[r]), np.maximum(ly1[q], ry1[r])) == here
                out_l.append(lid[q[ok]])
                out_r.append(rid[r[ok]])
        return pd.DataFrame({"left_id": np.concatenate(out_l), "right_id": np.concatenate(out_r)})

    out = T.StructType([T.StructField("left_id", left.schema["id"].dataType), T.StructField("right_id", right.schema["id"].dataType)])
    return regions.groupBy("part").cogroup(objects.groupBy("part")).applyInPandas(probe, out)
