"""Similarity clusters by power-iteration spectral clustering.

Records are folded into micro-clusters: the cells of a grid so fine that any two records of a cell are within ``reach`` of each
other. A cell keeps its record count, its bounding box and eight extreme records. Their number is bounded by the extent and
``reach`` however many records there are. The affinity of two cells falls with the distance of their nearest records
and is zero beyond ``reach``, which gives a sparse matrix. Divided by its row sums it is iterated on several random vectors at once,
in tiles of cells that keep the values at the edge of their halo and take the tile's inner values on. The iteration goes
on over shifted tiles until the clusters in question have settled: a linked group then has one value in each vector, and
different groups have different ones. A k-means over the rows of the vectors gives the clusters, and an exact check inside
each cluster trims what came there by chance.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspace.llm.topn import top_n_per_group
from loomspace.plans.runtime import materialize, ship

WORLD = (-180.0, -90.0, 180.0, 90.0)
#: Cells within two steps along each axis can hold records within reach.
NEAR = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) != (0, 0)]
#: At most this many rows of a few numbers each are broadcast; beyond it Spark's own joins do the work.
BROADCAST_CELLS = 1_000_000
#: Cells of a tile along each axis; a tile's working set is a few MB.
TILE = 96
BOX = ["x1", "y1", "x2", "y2"]
KEY = np.int64(10_000_003)


@dataclass(frozen=True)
class CellGrid:
    reach: float
    extent: tuple[float, float, float, float] = WORLD

    @property
    def side(self) -> float:
        return self.reach / math.sqrt(2) * (1 - 1e-9)

    @property
    def shape(self) -> tuple[int, int]:
        x0, y0, x1, y1 = self.extent
        return int((x1 - x0) / self.side) + 1, int((y1 - y0) / self.side) + 1

    @property
    def most_cells(self) -> int:
        """No data can occupy more cells."""
        return self.shape[0] * self.shape[1]

    def columns(self, x: str = "x", y: str = "y") -> list[Column]:
        at = lambda c, o: F.floor((F.col(c).cast("double") - F.lit(float(o))) / F.lit(self.side)).cast("int")
        return [at(x, self.extent[0]).alias("cx"), at(y, self.extent[1]).alias("cy")]


def _extremes(x: Column, y: Column) -> list[Column]:
    """Bounding box and the eight records farthest to each side and corner, as ``x1, y1, x2, y2, rx, ry``."""
    s, t = x + y, x - y
    xs = [F.min(x), F.max(x), F.min_by(x, y), F.max_by(x, y), F.min_by(x, s), F.max_by(x, s), F.min_by(x, t), F.max_by(x, t)]
    ys = [F.min_by(y, x), F.max_by(y, x), F.min(y), F.max(y), F.min_by(y, s), F.max_by(y, s), F.min_by(y, t), F.max_by(y, t)]
    return [F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x).alias("x2"), F.max(y).alias("y2"), F.array(*xs).alias("rx"), F.array(*ys).alias("ry")]


def fold_cells(points: DataFrame, grid: CellGrid) -> DataFrame:
    """``cx, cy, n, mx, my, x1, y1, x2, y2, rx, ry``: the occupied cells; hot cells are combined on the map side."""
    p = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *grid.columns())
    x, y = F.col("x"), F.col("y")
    return p.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), *_extremes(x, y))


def _neighbours(key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset of ``NEAR`` its number and the pairs of cells that lie so."""
    order = np.argsort(key)
    ordered = key[order]
    for o, (dx, dy) in enumerate(NEAR):
        want = key + dx * KEY + dy
        at = np.minimum(np.searchsorted(ordered, want), max(0, len(key) - 1))
        i = np.flatnonzero(ordered[at] == want) if len(key) else np.zeros(0, np.int64)
        yield o, i, order[at[i]]


def cell_links(cx: np.ndarray, cy: np.ndarray, rx: np.ndarray, ry: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked cell pairs (each once) and the squared distance of their nearest extreme records."""
    left, right, near = [], [], []
    for o, i, j in _neighbours(cx.astype(np.int64) * KEY + cy):
        if NEAR[o] < (0, 0):
            continue
        for lo in range(0, len(i), 50_000):
            a, b = i[lo : lo + 50_000], j[lo : lo + 50_000]
            d2 = ((rx[a][:, :, None] - rx[b][:, None, :]) ** 2 + (ry[a][:, :, None] - ry[b][:, None, :]) ** 2).reshape(len(a), -1).min(axis=1)
            ok = d2 <= reach * reach
            left.append(a[ok])
            right.append(b[ok])
            near.append(d2[ok])
    empty = np.zeros(0, np.int64)
    return np.concatenate([*left, empty]), np.concatenate([*right, empty]), np.concatenate([*near, np.zeros(0)])


def _whole(n: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> np.ndarray:
    """Whether a fold has no more records than distinct extremes, so that these are all of its records."""
    z = np.sort(rx + 1j * ry, axis=1)
    return n <= 1 + (z[:, 1:] != z[:, :-1]).sum(axis=1)


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``size`` numbers the least one that the links ``a``-``b`` connect it with."""
    root = np.arange(size)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _start(cx: np.ndarray, cy: np.ndarray, vectors: int) -> np.ndarray:
    """Random start vectors in [-1, 1) that depend on the cell alone."""
    with np.errstate(over="ignore"):
        z = (cx.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (cy.astype(np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (np.arange(1, vectors + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return z.astype(np.float64) / 2.0**63 - 1.0


def _unpack(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, width)


def _pack(values: np.ndarray) -> pd.Series:
    """Each row's float32 bytes."""
    size = values.shape[1] * 4
    raw = np.ascontiguousarray(values, np.float32).tobytes()
    return pd.Series([raw[i * size : (i + 1) * size] for i in range(len(values))], dtype=object)


def _tiles(df: DataFrame, halo: int, tile: int, shift: int = 0) -> DataFrame:
    """A row for each tile (``tx, ty``) in which, or within ``halo`` cells of which, the cell lies."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) + shift - halo) / tile).cast("int"), F.floor((F.col(c) + shift + halo) / tile).cast("int")))
    spread = df.select("*", span("cx").alias("tx")).select("*", span("cy").alias("ty"))
    # a given number of partitions: their few bytes would else be merged into one or two, each for long work
    return spread.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tx", "ty")


def _inner(pdf: pd.DataFrame, tile: int, shift: int = 0) -> np.ndarray:
    return (((pdf["cx"] + shift) // tile == pdf["tx"]) & ((pdf["cy"] + shift) // tile == pdf["ty"])).to_numpy()


LINKED = T.StructType([
    T.StructField("cx", T.IntegerType()), T.StructField("cy", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("w", T.BinaryType()),
    T.StructField("px", T.IntegerType()), T.StructField("py", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in (*BOX, *(f"p{c}" for c in BOX))),
])


def affinities(cells: DataFrame, points: DataFrame, grid: CellGrid, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """``cx, cy, n, w`` (the affinities to the cells at the offsets of ``NEAR``, packed) and ``cx, cy, px, py, d2`` (further links).

    Two cells are linked if any two of their records are within reach. Extreme records decide nearly all of it; where they don't
    link two cells with bounding boxes in reach, and no other links of the tile join them either, all records are asked.
    """
    reach = grid.reach

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        cx, cy, inner = pdf["cx"].to_numpy(np.int64), pdf["cy"].to_numpy(np.int64), _inner(pdf, tile)
        rx, ry = np.stack(pdf["rx"].to_numpy()), np.stack(pdf["ry"].to_numpy())
        a, b, d2 = cell_links(cx, cy, rx, ry, reach)
        whole = _whole(pdf["n"].to_numpy(), rx, ry)
        w = np.zeros((len(cx), len(NEAR)), np.float32)
        value = np.exp(-d2 / (reach * reach))
        offset = (cx[b] - cx[a] + 2) * 5 + cy[b] - cy[a] + 2
        offset -= offset > 12  # the cell itself isn't among the offsets
        w[a, offset] = value
        w[b, len(NEAR) - 1 - offset] = value
        root = _roots(len(cx), a, b)
        box = pdf[BOX].to_numpy()
        i, j, _ = cell_links(cx, cy, np.zeros((len(cx), 1)), np.zeros((len(cx), 1)), reach)
        gx = np.maximum(0, np.maximum(box[i, 0] - box[j, 2], box[j, 0] - box[i, 2]))
        gy = np.maximum(0, np.maximum(box[i, 1] - box[j, 3], box[j, 1] - box[i, 3]))
        ask = (gx * gx + gy * gy <= reach * reach * (1 + 1e-9)) & (root[i] != root[j]) & inner[i] & ~(whole[i] & whole[j])
        i, j = i[ask], j[ask]
        own = pd.DataFrame({"cx": cx[inner], "cy": cy[inner], "n": pdf["n"].to_numpy()[inner], "w": _pack(w[inner])})
        asked = pd.DataFrame({"cx": cx[i], "cy": cy[i], "n": 0, "px": cx[j], "py": cy[j], **{c: box[i, k] for k, c in enumerate(BOX)}, **{f"p{c}": box[j, k] for k, c in enumerate(BOX)}})
        made = pd.concat([own, asked]).reindex(columns=LINKED.fieldNames())
        return made.astype({"cx": "int32", "cy": "int32", "n": "int64", "px": "Int32", "py": "Int32"})

    spread = _tiles(cells.select("cx", "cy", "n", *BOX, "rx", "ry"), 2, tile)
    both = materialize(spread.groupBy("tx", "ty").applyInPandas(link, LINKED))
    asked = both.filter("px IS NOT NULL").drop("n", "w")
    return both.filter("px IS NULL").select("cx", "cy", "n", "w"), exact_links(asked, points, grid)


PAIR = ["cx", "cy", "px", "py"]


def exact_links(asked: DataFrame, points: DataFrame, grid: CellGrid, finer: int = 16) -> DataFrame:
    """``cx, cy, px, py, d2`` of the asked pairs of cells that have records within reach of each other.

    The records of both cells within reach of the other's box are folded into ``finer`` × ``finer`` parts, whose extreme records and
    boxes decide again; pairs of parts that stay open are divided further, down to single places. So a task gets at most
    ``2 * finer²`` rows of a pair, however many records the cells hold.
    """
    reach2, boxes = grid.reach**2, [*BOX, *(f"p{c}" for c in BOX)]
    xy = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *(c.alias(n) for c, n in zip(grid.columns(), ("hx", "hy"), strict=True)))
    out = T.StructType([*(T.StructField(c, T.IntegerType()) for c in PAIR), T.StructField("d2", T.DoubleType()), *(T.StructField(c, T.DoubleType()) for c in boxes)])

    def parts(asked: DataFrame, rows: int) -> DataFrame:
        """Either side's records near the other's box, folded; one pass over the points."""
        sides = [asked.select(*PAIR, *boxes, F.lit(k).alias("side"), *(F.col(c).alias(n) for c, n in zip(PAIR[2 * k : 2 * k + 2], ("hx", "hy"), strict=True)), *(F.col(c).alias(f"o{n}") for c, n in zip(boxes[4 * k : 4 * k + 4] + boxes[4 - 4 * k : 8 - 4 * k], boxes, strict=True))) for k in (0, 1)]
        both = sides[0].unionByName(sides[1])
        rows_in = xy.join(F.broadcast(both) if 2 * rows <= BROADCAST_CELLS else both, ["hx", "hy"])
        x, y, (x1, y1, x2, y2, u1, v1, u2, v2) = F.col("x"), F.col("y"), (F.col(f"o{n}") for n in boxes)
        gx, gy = F.greatest(x - u2, u1 - x, F.lit(0.0)), F.greatest(y - v2, v1 - y, F.lit(0.0))
        rows_in = rows_in.filter(x.between(x1, x2) & y.between(y1, y2) & (gx * gx + gy * gy <= reach2 * (1 + 1e-9)))
        part = lambda v, lo, hi: F.when(hi > lo, F.least(F.lit(finer - 1), F.floor((v - lo) / (hi - lo) * finer))).otherwise(F.lit(0)).cast("int")
        placed = rows_in.select(*PAIR, *(F.col(c).alias(f"q{c}") for c in boxes), "side", part(x, x1, x2).alias("sx"), part(y, y1, y2).alias("sy"), "x", "y")
        return placed.groupBy(*PAIR, *(f"q{c}" for c in boxes), "side", "sx", "sy").agg(F.count(F.lit(1)).alias("n"), *_extremes(x, y))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        p, q = a[BOX].to_numpy(), b[BOX].to_numpy()
        gx = np.maximum(0, np.maximum(p[:, None, 0] - q[None, :, 2], q[None, :, 0] - p[:, None, 2]))
        gy = np.maximum(0, np.maximum(p[:, None, 1] - q[None, :, 3], q[None, :, 1] - p[:, None, 3]))
        i, j = np.nonzero(gx * gx + gy * gy <= reach2 * (1 + 1e-9))
        least, open_i, open_j = np.inf, [i[:0]], [j[:0]]
        if len(i):
            ax, ay, bx, by = (np.stack(t[c].to_numpy()) for t, c in ((a, "rx"), (a, "ry"), (b, "rx"), (b, "ry")))
            known = [_whole(t["n"].to_numpy(), rx, ry) | ((t["x1"] == t["x2"]) & (t["y1"] == t["y2"])).to_numpy() for t, rx, ry in ((a, ax, ay), (b, bx, by))]
            for lo in range(0, len(i), 50_000):
                s, t = i[lo : lo + 50_000], j[lo : lo + 50_000]
                d2 = ((ax[s][:, :, None] - bx[t][:, None, :]) ** 2 + (ay[s][:, :, None] - by[t][:, None, :]) ** 2).reshape(len(s), -1).min(axis=1)
                least = min(least, float(d2.min()))
                unsure = ~(known[0][s] & known[1][t])
                open_i.append(s[unsure])
                open_j.append(t[unsure])
        row = dict(zip(PAIR, (int(pdf[c].iat[0]) for c in PAIR), strict=True))
        if least <= reach2:
            return pd.DataFrame([row | {"d2": least}]).reindex(columns=out.fieldNames())
        s, t = np.concatenate(open_i), np.concatenate(open_j)
        return pd.DataFrame({**{c: np.full(len(s), v, np.int32) for c, v in row.items()}, "d2": np.full(len(s), np.nan), **{c: p[s, k] for k, c in enumerate(BOX)}, **{f"p{c}": q[t, k] for k, c in enumerate(BOX)}})

    found, none = None, asked.sparkSession.createDataFrame([], T.StructType(out.fields[:5]))
    while rows := asked.count():
        tested = materialize(parts(asked, rows).groupBy(*PAIR, *(f"q{c}" for c in boxes)).applyInPandas(test, out))
        met = tested.filter("d2 >= 0 AND NOT isnan(d2)").select(*PAIR, "d2")
        found = met if found is None else found.unionByName(met)
        asked = tested.filter("d2 IS NULL OR isnan(d2)").drop("d2").join(met, PAIR, "left_anti").distinct()
    return none if found is None else found.groupBy(*PAIR).agg(F.min("d2").alias("d2"))


def power_iterate(linked: DataFrame, further: DataFrame, reach: float, before: DataFrame | None = None, vectors: int = 4, steps: int = 64, halo: int = 16, tile: int = TILE, shift: int = 0, bound: float = 0.98) -> DataFrame:
    """``cx, cy, n, w, v, gap``: one round of the power iteration on ``vectors`` vectors, which start at random or with ``before``.

    Each tile multiplies ``steps`` times by the normalised affinities, with the momentum that is best if all eigenvalues but the
    leading ones are below ``bound``; larger ones settle too, only slower. The outermost two cells of the halo keep their values.
    A group that lies within a tile and its halo settles in one round; larger ones take several, with tiles shifted in between.
    ``w`` comes out with the links of ``further`` added; ``gap`` is the largest difference from a linked cell, near zero once settled.
    """
    momentum = 2 / (1 + math.sqrt(1 - bound * bound))
    kept = T.StructType([*LINKED.fields[:4], T.StructField("v", T.BinaryType()), T.StructField("gap", T.FloatType())])
    number, started = {o: k for k, o in enumerate(NEAR)}, before is not None

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        extra, pdf = pdf[pdf["w"].isna()], pdf[pdf["w"].notna()]
        cx, cy, inner = pdf["cx"].to_numpy(np.int64), pdf["cy"].to_numpy(np.int64), _inner(pdf, tile, shift)
        if not inner.any():
            return pd.DataFrame({c: [] for c in kept.fieldNames()}).astype({"cx": "int32", "cy": "int32", "n": "int64", "gap": "float32"})
        w = _unpack(pdf["w"], len(NEAR)).copy()
        key = cx * KEY + cy
        if len(extra):
            order = np.argsort(key)
            for x, y, px, py, d2 in extra[[*PAIR, "d2"]].itertuples(index=False):
                at = order[min(len(key) - 1, int(np.searchsorted(key[order], x * KEY + y)))]
                if key[at] == x * KEY + y:
                    w[at, number[int(px - x), int(py - y)]] = math.exp(-d2 / (reach * reach))
        src, dst, weight = [np.arange(len(cx))], [np.arange(len(cx))], [np.ones(len(cx), np.float32)]
        for o, i, j in _neighbours(key):
            on = w[i, o] > 0
            src.append(i[on])
            dst.append(j[on])
            weight.append(w[i[on], o])
        src, dst, weight = np.concatenate(src), np.concatenate(dst), np.concatenate(weight)
        order = np.argsort(src, kind="stable")
        src, dst, weight = src[order], dst[order], weight[order]
        first = np.searchsorted(src, np.arange(len(cx)))  # every cell has at least its own entry
        weight = (weight / np.add.reduceat(weight, first)[src])[:, None]
        v = _unpack(pdf["v"], vectors).copy() if started else _start(cx, cy, vectors).astype(np.float32)
        lo_x, lo_y = (int(pdf[c].iat[0]) * tile - shift - halo + 2 for c in ("tx", "ty"))
        side = tile + 2 * halo - 4
        fixed = np.flatnonzero((cx < lo_x) | (cx >= lo_x + side) | (cy < lo_y) | (cy >= lo_y + side))
        held, old = v[fixed], v
        v = np.add.reduceat(v[dst] * weight, first, axis=0)
        v[fixed] = held
        for _ in range(steps - 1):
            new = np.float32(momentum) * np.add.reduceat(v[dst] * weight, first, axis=0) + np.float32(1 - momentum) * old
            new[fixed] = held
            old, v = v, new
        gap = np.maximum.reduceat(np.abs(v[dst] - v[src]).max(axis=1), first)
        return pd.DataFrame({"cx": cx[inner].astype(np.int32), "cy": cy[inner].astype(np.int32), "n": pdf["n"].to_numpy()[inner], "w": _pack(w[inner]), "v": _pack(v[inner]), "gap": gap[inner]})

    null = lambda c, t: F.lit(None).cast(t).alias(c)
    rows = linked if before is None else before
    rows = rows.select("cx", "cy", "n", "w", null("v", "binary") if before is None else "v", null("px", "int"), null("py", "int"), null("d2", "double"))
    both = [further, further.select(F.col("px").alias("cx"), F.col("py").alias("cy"), F.col("cx").alias("px"), F.col("cy").alias("py"), "d2")]
    for links in both if before is None else []:
        rows = rows.unionByName(links.select("cx", "cy", F.lit(0).cast("long").alias("n"), null("w", "binary"), null("v", "binary"), "px", "py", "d2"))
    return materialize(_tiles(rows, halo, tile, shift).groupBy("tx", "ty").applyInPandas(multiply, kept))


def fitted_centres(rows: DataFrame, vectors: int, seeds: np.ndarray | None = None, most: int = 1024, tolerance: float = 1e-3, iterations: int = 4) -> np.ndarray:
    """Centres of a k-means over the embedding ``cx, cy, n, v``.

    Given ``seeds`` come first, then the places of the embedding that hold most records: settled groups are single points there, the
    heavier the larger. At most ``most`` places are taken, none within twice the ``tolerance`` of a centre before it. A centre then moves
    to the weighted mean of the rows within ``tolerance`` of it that have no nearer centre (a mean over all its rows would
    drift off a settled group with whatever lies around it). Only sums over rows reach the driver, at most ``most`` of them.
    """
    spark = ship(rows.sparkSession)
    names = ["w", *(f"s{i}" for i in range(vectors))]
    partial = T.StructType([T.StructField("cluster", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def summed(batches: Iterator[pd.DataFrame], number) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, n = _unpack(b["v"], vectors).astype(np.float64), b["n"].to_numpy(np.float64)
                own, core = number(x)
                at, place = np.unique(own[core], return_inverse=True)
                sums = np.zeros((len(at), vectors + 1))
                np.add.at(sums, place, np.concatenate([n[:, None], x * n[:, None]], axis=1)[core])
                made = pd.DataFrame(sums, columns=names)
                made.insert(0, "cluster", at.astype(np.int64))
                yield made

    def bucket(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.zeros(len(x), np.uint64)
        with np.errstate(over="ignore"):
            for column in np.floor(x / (4 * tolerance)).astype(np.int64).T:
                h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h.astype(np.int64), np.ones(len(x), bool)

    def totals(number) -> DataFrame:
        return rows.select("n", "v").mapInPandas(lambda it: summed(it, number), partial).groupBy("cluster").agg(*(F.sum(n).alias(n) for n in names))

    heavy = totals(bucket).orderBy(F.col("w").desc(), "cluster").limit(most).toPandas()
    wanted = heavy[names[1:]].to_numpy() / heavy[["w"]].to_numpy()
    at = np.zeros((0, vectors))
    for c in wanted if seeds is None else np.concatenate([seeds.astype(np.float64), wanted]):
        if not len(at) or ((at - c) ** 2).sum(axis=1).min() > (2 * tolerance) ** 2:
            at = np.concatenate([at, c[None]])
    for _ in range(iterations if len(at) else 0):
        shared = spark.sparkContext.broadcast(at)
        got = totals(lambda x, shared=shared: nearest_centre(x, shared.value, tolerance)).toPandas()
        new = at.copy()
        new[got["cluster"].to_numpy()] = got[names[1:]].to_numpy() / got[["w"]].to_numpy()
        moved, at = float(np.abs(new - at).max()), new
        if moved <= tolerance / 4:
            break
    return at


def nearest_centre(x: np.ndarray, centres: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centre, and whether it is within ``tolerance``."""
    own = np.empty(len(x), np.int32)
    half = (centres * centres).sum(axis=1) / 2
    for lo in range(0, len(x), 4096):
        own[lo : lo + 4096] = np.argmin(half - x[lo : lo + 4096] @ centres.T, axis=1)
    return own, ((x - centres[own]) ** 2).sum(axis=1) <= tolerance * tolerance


def labelled(rows: DataFrame, centres: np.ndarray, tolerance: float = 1e-3) -> DataFrame:
    """``rows`` with ``cluster``: twice the number of the nearest centre, and one more if the row isn't within ``tolerance`` of it."""
    shared = ship(rows.sparkSession).sparkContext.broadcast(centres)

    @F.pandas_udf(T.IntegerType())
    def label(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="int32")
        own, core = nearest_centre(_unpack(v, shared.value.shape[1]).astype(np.float64), shared.value, tolerance)
        return pd.Series(2 * own + ~core, dtype="int32")

    return rows.withColumn("cluster", label("v"))


def trimmed(rows: DataFrame, grid: CellGrid, tile: int = TILE) -> DataFrame:
    """``cx, cy, cluster, part, leak``: clusters divided into their linked parts, by links between cells of one cluster alone.

    ``leak`` says that the cell is linked to a cell outside its cluster, or outside ``rows``. Tiles find the parts on their own; links
    across their borders are then joined in tiles eight times as wide, and so on, so no task gets more than the links along
    some borders.
    """
    out = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("cx", "cy", "cluster")), T.StructField("part", T.LongType()), T.StructField("other", T.LongType()), T.StructField("leak", T.BooleanType())])

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        cx, cy, cluster, inner = pdf["cx"].to_numpy(np.int64), pdf["cy"].to_numpy(np.int64), pdf["cluster"].to_numpy(), _inner(pdf, tile)
        w, key = _unpack(pdf["w"], len(NEAR)), cx * KEY + cy
        ends, met = [], np.zeros((len(cx), len(NEAR)), bool)
        for o, i, j in _neighbours(key):
            on = (w[i, o] > 0) & (cluster[i] == cluster[j])
            met[i[on], o] = True
            ends.append(np.stack([i[on], j[on]]))
        a, b = np.concatenate(ends, axis=1)
        own = inner[a] & inner[b]
        root = key[_roots(len(cx), a[own], b[own])]
        across = inner[a] & ~inner[b]
        at = np.flatnonzero(inner)
        made = pd.DataFrame({"cx": cx[at], "cy": cy[at], "cluster": cluster[at], "part": root[at], "other": pd.array([pd.NA] * len(at), "Int64"), "leak": ((w > 0) & ~met).any(axis=1)[at]})
        links = pd.DataFrame({"cx": cx[b[across]], "cy": cy[b[across]], "cluster": cluster[a[across]], "part": root[a[across]], "other": pd.array(key[b[across]], "Int64"), "leak": False})
        return pd.concat([made, links]).astype({"cx": "int32", "cy": "int32", "cluster": "int32"})

    found = materialize(_tiles(rows.select("cx", "cy", "cluster", "w"), 2, tile).groupBy("tx", "ty").applyInPandas(split, out))
    parts = found.filter("other IS NULL").drop("other")
    # the far end of a link across a border is named by its cell; its part is known in the cell's own tile
    ends = parts.select("cx", "cy", F.col("part").alias("other"))
    links = materialize(found.filter("other IS NOT NULL").select("cx", "cy", "part").distinct().join(ends, ["cx", "cy"]).select("part", "other").distinct())
    merge = T.StructType([T.StructField("part", T.LongType()), T.StructField("other", T.LongType()), T.StructField("root", T.LongType())])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf[["part", "other"]].to_numpy(np.int64).ravel(), return_inverse=True)
        at = at.reshape(-1, 2)
        root = names[_roots(len(names), at[:, 0], at[:, 1])]
        moved = root != names
        return pd.DataFrame({"part": names[moved], "other": names[moved], "root": root[moved]})

    width = tile
    while not links.isEmpty():
        width *= 8
        block = lambda c: (F.floor(F.col(c) / int(KEY) / width), F.floor(F.col(c) % int(KEY) / width))
        (a, b), (c, d) = block("part"), block("other")
        placed = links.withColumns({"bx": a, "by": b, "same": (a == c) & (b == d)})
        roots = materialize(placed.filter("same").groupBy("bx", "by").applyInPandas(join, merge)).select("part", "root")
        step = lambda df, c: df.join(roots.withColumnRenamed("part", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        parts = step(parts, "part")
        links = materialize(step(step(placed.filter("NOT same").select("part", "other"), "part"), "other").filter("part <> other").distinct())
    return parts


def _placed(points: DataFrame, extent: tuple[float, float, float, float]) -> DataFrame:
    return points.filter(F.col("x").between(extent[0], extent[2]) & F.col("y").between(extent[1], extent[3]) & F.col("id").isNotNull()).select("id", "x", "y")


def _with_cells(points: DataFrame, cells: DataFrame, grid: CellGrid, rows: int) -> DataFrame:
    """Points with the columns of their cell; ``cells``, of ``rows`` rows, are broadcast up to a fixed number."""
    small = F.broadcast(cells) if rows <= BROADCAST_CELLS else cells
    return points.select("id", "x", "y", *grid.columns()).join(small, ["cx", "cy"])


def affinity_bounds(cells: DataFrame, reach: float, tile: int = TILE) -> DataFrame:
    """``cx, cy, cluster, n, lower, upper``: between which bounds the internal affinities of a cell's records lie.

    Tiles of cells with a halo of two cells on each side, as in ``power_iterate``.
    """
    names = ["cx", "cy", "cluster", "n", "mx", "my", "x1", "y1", "x2", "y2"]
    out = T.StructType([*(cells.schema[c] for c in names[:4]), T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        cx, cy, cluster, n, mx, my, x1, y1, x2, y2 = (pdf[c].to_numpy() for c in names)
        key = cx.astype(np.int64) * KEY + cy
        order = np.argsort(key)
        ordered = key[order]
        low, high = np.zeros(len(key)), np.zeros(len(key))
        for dx, dy in [*NEAR, (0, 0)]:
            want = key + dx * KEY + dy
            at = np.minimum(np.searchsorted(ordered, want), len(key) - 1)
            j = order[at]
            ok = (ordered[at] == want) & (cluster == cluster[j])
            gap = np.maximum(0, np.maximum(x1 - mx[j], mx[j] - x2)) ** 2 + np.maximum(0, np.maximum(y1 - my[j], my[j] - y2)) ** 2
            wide = np.maximum(np.abs(x1 - mx[j]), np.abs(mx[j] - x2)) ** 2 + np.maximum(np.abs(y1 - my[j]), np.abs(my[j] - y2)) ** 2
            high += np.where(ok, n[j] * np.exp(-gap / (reach * reach)), 0)
            low += np.where(ok, n[j] * np.exp(-wide / (reach * reach)), 0)
        return pd.DataFrame({"cx": cx, "cy": cy, "cluster": cluster, "n": n, "lower": low, "upper": high})[_inner(pdf, tile)]

    return _tiles(cells.select(*names), 2, tile).groupBy("tx", "ty").applyInPandas(bound, out)


def spectral_labels(cells: DataFrame, points: DataFrame, grid: CellGrid, vectors: int = 4, tolerance: float = 1e-3, most_centres: int = 1024, most_rounds: int = 40, tile: int = TILE) -> DataFrame:
    """``cx, cy, n, w, v, gap, cluster``: the cells with their spectral cluster.

    The power iteration goes on until all cells agree with those they are linked to within a twentieth of ``tolerance``, or until another round lessens the
    records that don't by less than a tenth: what is left is thin ground that hangs together over long ways and has no groups.
    """
    linked, further = affinities(cells, points, grid, tile)
    v, left = None, math.inf
    for n in range(most_rounds):
        v = power_iterate(linked, further, grid.reach, v, vectors, tile=tile, shift=n % 2 * (tile // 2))
        still = v.filter(F.col("gap") > tolerance / 20).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not still or still > 0.9 * left:
            break
        left = still
    return labelled(v, fitted_centres(v, vectors, None, most_centres, tolerance), tolerance)


def spectral_clusters(points: DataFrame, reach: float, typical: int = 5, extent: tuple[float, float, float, float] = WORLD, **options: float) -> DataFrame:
    """Clusters of the records ``id, x, y``: ``cluster, records, cells, typical`` (ids, most typical first).

    The clusters are those of ``spectral_labels`` (which takes the ``options``), each divided into the parts that its own links hold together: what
    came into a cluster by chance is a cluster of its own. A settled group is one point of the embedding, so it is never divided and
    never shares a cluster with what it isn't linked to; thin ground that doesn't settle is divided where the embedding is.

    A record's internal affinity is the sum of ``exp(-d² / reach²)`` over the nearby cells of its own cluster, times their record
    counts; the ``typical`` records of highest affinity are named, equal ones by smaller id. Cells whose upper bound stays below
    a lower bound that enough records of the cluster reach are left out beforehand, which changes nothing.

    Records with a NULL id or a missing, NaN, infinite or outlying coordinate are left out; repeated ids, whose
    places must agree, count once; other columns are ignored; an empty table gives no clusters.
    """
    grid = CellGrid(reach, extent)
    points = materialize(_placed(points, extent).groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y")))
    cells = materialize(fold_cells(points, grid))
    parts = trimmed(spectral_labels(cells, points, grid, **options), grid)
    cells = materialize(cells.join(parts.select("cx", "cy", F.col("part").alias("cluster")), ["cx", "cy"]))
    bounds = materialize(affinity_bounds(cells, reach))
    sure = bounds.filter(F.col("n") >= typical).groupBy("cluster").agg(F.max("lower").alias("floor"))
    survivors = bounds.join(sure, "cluster", "left").filter(F.col("upper") >= F.coalesce("floor", F.lit(0.0)) * (1 - 1e-9)).select("cx", "cy", "cluster")
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [*NEAR, (0, 0)]))).alias("o")
    wanted = survivors.select("*", around).withColumns({"px": F.col("cx") + F.col("o.a"), "py": F.col("cy") + F.col("o.b")}).drop("o")
    there = cells.select(F.col("cx").alias("px"), F.col("cy").alias("py"), "cluster", F.struct("n", "mx", "my").alias("at"))
    near = wanted.join(there, ["px", "py", "cluster"]).groupBy("cx", "cy", "cluster").agg(F.collect_list("at").alias("near"))
    scored = points.select("id", "x", "y", *grid.columns()).join(near, ["cx", "cy"])
    part = lambda e: e["n"] * F.exp(-((F.col("x") - e["mx"]) ** 2 + (F.col("y") - e["my"]) ** 2) / (reach * reach))
    # rounded, so that the order in which a sum is formed can't decide a tie
    scored = scored.select("cluster", "id", F.round(F.aggregate("near", F.lit(0.0), lambda acc, e: acc + part(e)), 6).alias("affinity"))
    best = top_n_per_group(scored, ["cluster"], "affinity", "id", typical, agreeing=True).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda e: e["id"]).alias("typical"))
    members = _with_cells(points, cells.select("cx", "cy", "cluster"), grid, grid.most_cells)
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("records"))
    counts = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("cells"))
    return sizes.join(counts, "cluster").join(best, "cluster", "left")


def anchored_groups(
    points: DataFrame, anchors: DataFrame, reach: float, extent: tuple[float, float, float, float] = WORLD, vectors: int = 4, tolerance: float = 1e-3,
    most_centres: int = 1024, most_rounds: int = 200, tile: int = TILE, labels: Callable[[DataFrame, np.ndarray, float], DataFrame] = labelled,
) -> DataFrame:
    """``anchor_id, id``: the records that an anchor reaches by steps of at most ``reach``.

    They are the members of the anchor's spectral cluster; an exact check inside the cluster leaves out what its own links don't
    connect with the anchor. As long as one of the members is linked to a cell outside the cluster, the vectors haven't settled there
    and the power iteration goes on; after ``most_rounds`` it gives up with an error rather than return part of a group. ``labels``
    may put another clustering of the embedding in place of the nearest centre.

    Records and anchors with a NULL id or a missing, NaN, infinite or outlying coordinate are left out; repeated rows count once;
    an anchor without a record within reach gives no rows, as do empty tables; other columns are ignored. An anchor stands as a place
    of its own in its cell. The k-means has a centre for each anchor, so anchors should number in the thousands at most.
    """
    ship(points.sparkSession)
    grid = CellGrid(reach, extent)
    points = _placed(points, extent)
    anchors = materialize(_placed(anchors.withColumnRenamed("anchor_id", "id"), extent).distinct().select(F.col("id").alias("anchor_id"), "x", "y", *grid.columns()))
    places = points.select("x", "y").unionByName(anchors.select("x", "y"))
    cells = materialize(fold_cells(places, grid).drop("mx", "my"))
    linked, further = affinities(cells, places, grid, tile)
    starts = anchors.select("anchor_id", "cx", "cy")
    v = None
    for n in range(most_rounds):
        v = power_iterate(linked, further, reach, v, vectors, tile=tile, shift=n % 2 * (tile // 2))
        seeds = v.join(starts.select("cx", "cy").distinct(), ["cx", "cy"]).orderBy("cx", "cy").select("v").toPandas()
        if not len(seeds):
            return anchors.select("anchor_id").join(points.select("id").limit(0), F.lit(True))
        centres = fitted_centres(v, vectors, _unpack(seeds["v"], vectors), most_centres, tolerance)
        own = labels(v.join(starts.select("cx", "cy").distinct(), ["cx", "cy"]), centres, tolerance).select("cluster").distinct()
        parts = trimmed(labels(v, centres, tolerance).join(own, "cluster"), grid, tile)
        mine = parts.join(starts, ["cx", "cy"]).select("anchor_id", "part").distinct()
        kept = materialize(parts.join(mine, "part").select("anchor_id", "cx", "cy", "leak"))
        size, leaks = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("leak").cast("int")), F.lit(0))).first()
        if not leaks:
            return _with_cells(points, kept.drop("leak"), grid, size).select("anchor_id", "id").distinct()
    raise RuntimeError(f"the vectors have not settled around the anchors after {most_rounds} rounds")
