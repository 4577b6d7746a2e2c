"""Exact nearest-neighbour joins.

A quadtree over a bounded sample divides the places into leaves; one aggregation by leaf gives their row counts and tight bounding
boxes (at most ``max_leaves`` rows). A query, or a group of nearby queries, takes leaves in the order of their farthest corner until
they hold k places: that distance bounds the k-th neighbour. It then visits every leaf whose nearest edge is within the bound, which an
R-tree over the leaves finds.
Leaves that stay too full, or that many queries ask for, are divided by hashes of the ids on either side. Each part ranks its
own candidates, and only k rows a query and part go to the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspace.functions import geometry as G
from loomspace.functions.hilbert import hilbert_of_place
from loomspace.operators.proximity import Parts
from loomspace.operators.quadtree import build_quadtree, sample_places
from loomspace.operators.rtree import PackedRTree
from loomspace.plans.runtime import materialize, ship

#: Covers single-precision differences in the bounds, which are computed in double.
SLACK, LEAST = 1 + 1e-5, 1e-6


class Leaves:
    """The occupied leaves in curve order: how many places each holds and their bounding box."""

    def __init__(self, leaf: np.ndarray, count: np.ndarray, box: np.ndarray):
        order = np.argsort(leaf)
        self.leaf, self.count, self.box = leaf[order], count[order], box[order]
        self.index = PackedRTree(*self.box.T)

    def _far2(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distance to the farthest corner."""
        b = self.box[at]
        return (np.maximum(np.abs(q[..., 0:2] - b[..., 2:4]), np.abs(q[..., 2:4] - b[..., 0:2])) ** 2).sum(axis=-1)

    def _enough(self, q: np.ndarray, position: np.ndarray, k: int) -> np.ndarray:
        """Squared radius within which each query has ``k`` places, by the leaves next to its own along the curve; infinite if there
        aren't ``k`` places at all."""
        r2, todo, width = np.full(len(q), np.inf), np.arange(len(q)), 4
        while len(todo) and self.count.sum() >= k:
            at = position[todo, None] + np.arange(-width, width + 1)
            inside = (at >= 0) & (at < len(self.leaf))
            at = np.clip(at, 0, len(self.leaf) - 1)
            far2 = np.where(inside, self._far2(q[todo, None], at), np.inf)
            order = np.argsort(far2, axis=1, kind="stable")
            held = np.cumsum(np.take_along_axis(np.where(inside, self.count[at], 0), order, 1), axis=1)
            done = held[:, -1] >= k
            first = np.take_along_axis(order, np.argmax(held >= k, axis=1)[:, None], 1)
            r2[todo[done]] = np.take_along_axis(far2, first, 1)[done, 0]
            todo, width = todo[~done], width * 4
        return r2

    def visits(self, q: np.ndarray, position: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, leaf number) to visit, for query rectangles ``q`` (x1, y1, x2, y2) at their places along the curve.

        The leaves near a query along the curve give a first radius; of all leaves within it those with the nearest far corners
        that hold ``k`` places give the final one.
        """
        r2 = self._enough(q, position, k)
        r = np.sqrt(np.minimum(r2, 1e12)) * SLACK + LEAST
        for row, at in self.index.probe(q[:, 0] - r, q[:, 1] - r, q[:, 2] + r, q[:, 3] + r):
            order = np.lexsort((far2 := self._far2(q[row], at), row))
            row, at, far2 = row[order], at[order], far2[order]
            held = np.cumsum(self.count[at])
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            before = np.repeat(np.concatenate([[0], held])[starts], np.diff(np.append(starts, len(row))))
            full = held - before >= k
            least = np.minimum.reduceat(np.where(full, far2, np.inf), starts)
            bound = np.repeat(least, np.diff(np.append(starts, len(row)))) * SLACK + LEAST
            b, s = self.box[at], q[row]
            near = np.maximum(0, np.maximum(b[:, 0:2] - s[:, 2:4], s[:, 0:2] - b[:, 2:4]))
            keep = (near**2).sum(axis=1) <= bound
            yield row[keep], at[keep]

    def touched(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, leaf number) of rectangles and the leaves that they touch."""
        yield from self.index.probe(*q.T)


def _windows(x: np.ndarray, y: np.ndarray, side: float, factor: float) -> np.ndarray:
    """Rectangles (x1, y1, x2, y2): the grid cell of each place, scaled about its centre."""
    mx, my, half = (np.floor(x / side) + 0.5) * side, (np.floor(y / side) + 0.5) * side, factor * side / 2
    return np.stack([mx - half, my - half, mx + half, my + half], axis=1)


def _numbers(times: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row as many numbers as ``times`` says, from its ``start`` on."""
    return np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start, times)


def leaf_stats(places: DataFrame, leaf: Column) -> DataFrame:
    """``leaf, n, x1, y1, x2, y2``: one row for each occupied leaf, combined on the map side."""
    return places.withColumn("leaf", leaf).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *G.mbr())


def knn_join(
    points: DataFrame, queries: DataFrame, k: int, key_predicate: Column | None = None, value_predicate: Column | None = None,
    strategy: str = "each", rows: int | None = None, target: int = 8_192, max_leaves: int = 32_768, run: int = 50, order: int = 16, window: tuple[float, float] | None = None, sample_size: int = 400_000, most_queries: int = 16_384,
) -> DataFrame:
    """``qid, id, dist, rk``: for each query ``qid, qx, qy`` the ``k`` places ``id, x, y`` nearest to it, equal distances by id.

    The predicates are applied to the places before the ranking. Places and queries without finite coordinates or with a NULL id are left
    out; queries with the same place keep their own rows; repeated rows of either side count once; fewer than ``k`` places: all
    come out; ``k`` < 1 or an empty side: none. Further columns are ignored (after the predicates).

    ``strategy`` says how bounds are found and never changes the result: ``each`` (one bound a query), ``hilbert`` (runs of ``run`` queries
    along a Hilbert curve of the given ``order`` share the bound of their bounding box) or ``pivots`` (queries share the bound of
    their quadtree leaf's members).

    With ``window`` (cell side, factor) a query only looks into its grid cell scaled by the factor about the cell's centre, which makes
    the result approximate: see ``knn_join_approx``.
    """
    if strategy not in ("each", "hilbert", "pivots"):
        raise ValueError(f"unknown strategy {strategy}")
    spark = ship(points.sparkSession)
    kept = points
    for p in (key_predicate, value_predicate):
        kept = kept if p is None else kept.filter(p)
    kept = kept.filter(F.col("id").isNotNull() & G.is_finite(G.point())).select("id", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y")).distinct()
    asked = queries.filter(F.col("qid").isNotNull() & G.is_finite(G.point("qx", "qy"))).select("qid", F.col("qx").cast("float").alias("qx"), F.col("qy").cast("float").alias("qy"))
    out_schema = T.StructType([asked.schema["qid"], kept.schema["id"], T.StructField("dist", T.DoubleType())])
    if k < 1:
        return spark.createDataFrame([], out_schema.add("rk", T.LongType()))
    kept = materialize(kept)  # read four times below
    rows = kept.count() if rows is None else rows
    tree = build_quadtree(*sample_places(kept, "x", "y", rows, sample_size), leaf_share=target / max(1, rows), max_leaves=max_leaves)
    asked = asked.distinct()
    number = asked.count()
    drawn = sample_places(asked, "qx", "qy", number, 20_000)
    near = np.bincount(tree.leaf(*drawn), minlength=len(tree)) * (4.0 * number / max(1, len(drawn[0])))  # a query visits a few leaves around its own
    parts = Parts(tree.weight * rows, near, target, most_queries)
    where, divided = spark.sparkContext.broadcast((tree, parts)), bool((parts.regions > 1).any())

    @F.pandas_udf(T.IntegerType())
    def leaf_of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(where.value[0].leaf(x.to_numpy(), y.to_numpy()).astype(np.int32))

    @F.pandas_udf(T.LongType())
    def part_of(x: pd.Series, y: pd.Series, h: pd.Series) -> pd.Series:
        tree, parts = where.value
        leaf = tree.leaf(x.to_numpy(), y.to_numpy())
        return pd.Series(parts.first[leaf] + h.to_numpy() % parts.objects[leaf])

    def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, parts = where.value
        for b in batches:
            row, part = parts.of(tree.leaf(b["x"].to_numpy(), b["y"].to_numpy()), b["__h"].to_numpy(), False)
            yield b[["id", "x", "y"]].iloc[row].assign(part=part)

    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 31))
    placed = T.StructType([*kept.schema.fields, T.StructField("part", T.LongType())])
    # leaves with many queries too are divided on both sides
    held = kept.withColumn("__h", hashed("id")).mapInPandas(copied, placed) if divided else kept.withColumn("part", part_of("x", "y", hashed("id")))
    stats = leaf_stats(kept, leaf_of("x", "y")).toPandas()
    if not len(stats):
        return spark.createDataFrame([], out_schema.add("rk", T.LongType()))
    known = spark.sparkContext.broadcast(Leaves(stats["leaf"].to_numpy(), stats["n"].to_numpy(), stats[["x1", "y1", "x2", "y2"]].to_numpy(np.float64)))
    if strategy == "hilbert":
        asked = asked.withColumn("h", hilbert_of_place(F.col("qx"), F.col("qy"), order)).repartitionByRange("h").sortWithinPartitions("h").drop("h")
    visits = T.StructType([*asked.schema.fields, T.StructField("part", T.LongType())])
    asked = asked.withColumn("__h", hashed("qid"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, parts = where.value
        leaves = known.value
        for b in batches:
            if not len(b):
                continue
            x, y, hashes = b["qx"].to_numpy(np.float64), b["qy"].to_numpy(np.float64), b["__h"].to_numpy()
            group = np.arange(len(b)) if strategy == "each" or window else np.arange(len(b)) // run if strategy == "hilbert" else np.unique(tree.leaf(x, y), return_inverse=True)[1]
            at = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[at], prepend=-1))
            rect = np.stack([f.reduceat(v[at], starts) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))], axis=1)
            size = np.diff(np.append(starts, len(at)))
            middle = np.searchsorted(leaves.leaf, tree.leaf((rect[:, 0] + rect[:, 2]) / 2, (rect[:, 1] + rect[:, 3]) / 2))
            for g, see in leaves.visits(rect, middle, k) if window is None else leaves.touched(_windows(x, y, *window)):
                member = at[_numbers(size[g], starts[g])]  # every member of the group
                row, part = parts.of(np.repeat(leaves.leaf[see], size[g]), hashes[member], True)
                yield b[["qid", "qx", "qy"]].iloc[member[row]].assign(part=part)

    def rank(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            p = p.sort_values("id", kind="stable")
            ids, px, py = p["id"].to_numpy(), p["x"].to_numpy(np.float32), p["y"].to_numpy(np.float32)
            qids, qx, qy = q["qid"].to_numpy(), q["qx"].to_numpy(np.float32), q["qy"].to_numpy(np.float32)
            step = max(1, 2_000_000 // len(p))
            for lo in range(0, len(q), step):
                s = slice(lo, lo + step)
                d2 = (px[None] - qx[s, None]).astype(np.float64) ** 2 + (py[None] - qy[s, None]).astype(np.float64) ** 2
                if window is not None:
                    w = _windows(qx[s].astype(np.float64), qy[s].astype(np.float64), *window)
                    d2[(px[None] < w[:, 0:1]) | (px[None] > w[:, 2:3]) | (py[None] < w[:, 1:2]) | (py[None] > w[:, 3:4])] = np.inf
                keep = d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k] if len(p) > k else np.ones_like(d2, bool)
                if len(p) > k:  # of equal distances only as many as can still be among the first k, by id
                    last = keep & (d2 == np.where(keep, d2, -1).max(axis=1, keepdims=True))
                    keep &= ~last | (np.cumsum(last, axis=1) <= k)
                r, c = np.nonzero(keep & np.isfinite(d2))
                out.append(pd.DataFrame({"qid": qids[s][r], "id": ids[c], "dist": np.sqrt(d2[r, c])}))
        return pd.concat(out) if out else pd.DataFrame({"qid": q["qid"].iloc[:0], "id": p["id"].iloc[:0], "dist": pd.Series(dtype="float64")})

    candidates = asked.mapInPandas(route, visits).groupBy("part").cogroup(held.groupBy("part")).applyInPandas(rank, out_schema)
    nearest = Window.partitionBy("qid").orderBy("dist", "id")
    return candidates.withColumn("rk", F.row_number().over(nearest).cast("long")).filter(F.col("rk") <= k)


def knn_join_collected(points: DataFrame, queries: DataFrame, k: int, **options: object) -> DataFrame:
    """``qid, neighbours``: an array of ``struct<rk, id, dist>`` in order, for each query that has any."""
    flat = knn_join(points, queries, k, **options)
    return flat.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rk", "id", "dist"))).alias("neighbours"))


def knn_join_approx(points: DataFrame, queries: DataFrame, k: int, factor: float = 3.0, side: float = 4.0, **options: object) -> DataFrame:
    """A cheaper, approximate form: each query looks only into its grid cell grown ``factor`` times about the centre.

    A query may get fewer than ``k`` rows, or a farther one, where places are thin. Distances that do come out are exact. The other
    options, and what is left out, are those of ``knn_join``.
    """
    return knn_join(points, queries, k, window=(side, factor), **options)
