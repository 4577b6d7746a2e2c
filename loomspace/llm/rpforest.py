"""Nearest vectors through a forest of random-projection trees.

A tree halves the vectors again and again along random directions. The forest is fitted on a bounded sample and every row
is filed under one leaf of each tree. A query searches all trees through one priority queue, ordered by the least
distance that a subtree's cells can have, until it has seen ``visits`` leaves; the vectors filed there are ranked by exact
distance. The k-th of these distances then bounds the answer, and an exact check goes through the remaining leaves of
the first tree within that bound, so the result equals that of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspace.plans.runtime import materialize, ship

#: Relative slack on bounds, so that rounding never closes a leaf that holds a neighbour.
SLACK = 1e-9


@dataclass
class Forest:
    """Complete binary trees: ``direction[t, node]`` (unit vectors) and ``threshold[t, node]``, nodes numbered as in a heap."""

    direction: np.ndarray
    threshold: np.ndarray
    depth: int

    @property
    def trees(self) -> int:
        return len(self.threshold)

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def side(self, vectors: np.ndarray, tree: np.ndarray | int, node: np.ndarray) -> np.ndarray:
        """Signed distance of each vector from the plane of its node."""
        return np.einsum("ij,ij->i", vectors, self.direction[tree, node]) - self.threshold[tree, node]

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, shape (rows, trees)."""
        out = np.empty((len(vectors), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (self.side(vectors, t, node) > 0)
            out[:, t] = node - (self.leaves - 1)
        return out

    def search(self, q: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, tree and leaf of the first ``visits`` leaves that each query's queue over all trees yields, nearest bound first.

        The queues of all queries are the rows of one table and take a step at a time together; only the planes along the paths that
        they descend are looked at.
        """
        inner, n, every = self.leaves - 1, len(q), np.arange(len(q))
        size = self.trees + visits * self.depth
        bound = np.full((n, size), np.inf)
        of_tree, of_node = np.zeros((n, size), np.int32), np.zeros((n, size), np.int64)
        bound[:, : self.trees], of_tree[:, : self.trees] = 0.0, np.arange(self.trees)
        free, found = self.trees, []
        for _ in range(visits):
            at = np.argmin(bound, axis=1)
            least = bound[every, at]
            row = np.flatnonzero(np.isfinite(least))
            least, tree, node = least[row], of_tree[row, at[row]], of_node[row, at[row]]
            bound[every, at] = np.inf
            while (live := np.flatnonzero(node < inner)).size:
                m = self.side(q[row[live]], tree[live], node[live])
                near = 2 * node[live] + 1 + (m > 0)
                bound[row[live], free] = np.maximum(least[live], np.abs(m))
                of_tree[row[live], free], of_node[row[live], free] = tree[live], 4 * node[live] + 3 - near
                node[live] = near
                free += 1
            found.append((row, tree, node - inner))
        row, tree, leaf = (np.concatenate([f[i] for f in found]) for i in range(3))
        return row, tree.astype(np.int32), leaf.astype(np.int32)

    def within(self, q: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf: all leaves of the first tree that may hold a vector at most the query's ``radius`` away."""
        reach = radius * (1 + SLACK) + SLACK
        row, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for _ in range(self.depth):
            m = self.side(q[row], 0, node)
            right, left = m > -reach[row], m <= reach[row]
            row, node = np.concatenate([row[right], row[left]]), np.concatenate([2 * node[right] + 2, 2 * node[left] + 1])
        return row, (node - (self.leaves - 1)).astype(np.int32)


def fit_forest(sample: np.ndarray, rows: int, trees: int = 3, leaf_size: int = 128, max_depth: int = 14, seed: int = 11) -> Forest:
    """Split at sample medians until leaves hold about ``leaf_size`` of ``rows`` vectors, or at ``max_depth``.

    The depth bounds what is broadcast; ``Groups`` divides leaves that are still too full.
    """
    rng = np.random.default_rng(seed)
    depth = min(max_depth, max(0, math.ceil(math.log2(max(1.0, rows / leaf_size)))))
    dims, inner = sample.shape[1], (1 << depth) - 1
    direction = rng.normal(size=(trees, max(1, inner), dims))
    direction /= np.linalg.norm(direction, axis=2, keepdims=True)
    threshold = np.zeros((trees, max(1, inner)))
    for t in range(trees):
        members: dict[int, np.ndarray] = {0: np.arange(len(sample))}
        for node in range(inner):
            own = members.pop(node, np.zeros(0, np.int64))
            p = sample[own] @ direction[t, node]
            cut = float(np.median(p)) if len(p) else 0.0
            threshold[t, node] = cut
            if 2 * node + 1 < inner:
                members[2 * node + 1], members[2 * node + 2] = own[p <= cut], own[p > cut]
    return Forest(direction, threshold, depth)


def held_in_leaves(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """How many of the vectors each leaf holds, shape (trees, leaves)."""
    filed = forest.file(vectors)
    return np.stack([np.bincount(filed[:, t], minlength=forest.leaves) for t in range(forest.trees)])


class Groups:
    """Which leaves are searched together in one task.

    Neighbouring small leaves share a block of about ``most`` rows. A leaf with more is divided by a hash of the id, and a block
    with many queries by a hash of the query, so that a group has about ``most`` data rows and ``most`` queries at any size. ``held``
    is each leaf's share of the data and ``asked`` how many queries visit it, both of shape (trees, leaves); leaves that no query visits
    belong to no group.
    """

    def __init__(self, held: np.ndarray, asked: np.ndarray, most: int):
        rows, queries = held.ravel(), asked.ravel()
        self.leaves, self.wanted = held.shape[1], queries > 0
        fill = np.cumsum(np.where(self.wanted, np.minimum(rows, most) + 1, 0))
        full = np.cumsum(np.where(self.wanted, queries, 0))
        step = np.floor(fill / most) + np.floor(full / most)
        alone = self.wanted & ((rows > most) | (queries > most))
        step += np.cumsum(alone) + np.concatenate([[0], np.cumsum(alone)[:-1]])
        self.block = np.unique(step, return_inverse=True)[1]
        blocks = int(self.block.max()) + 1
        self.parts = np.maximum(1, np.ceil(np.bincount(self.block, np.where(self.wanted, rows, 0), blocks) / (2 * most))).astype(np.int64)
        self.splits = np.maximum(1, np.ceil(np.bincount(self.block, queries, blocks) / (2 * most))).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.parts * self.splits)[:-1]]).astype(np.int64)

    def _spread(self, tree: np.ndarray, leaf: np.ndarray, hashed: np.ndarray, data: bool) -> tuple[np.ndarray, np.ndarray]:
        at = tree.astype(np.int64) * self.leaves + leaf
        row = np.flatnonzero(self.wanted[at])
        block = self.block[at[row]]
        own, other = (self.parts, self.splits) if data else (self.splits, self.parts)
        mine, copies = hashed[row] % own[block], other[block]
        rank = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
        row, block, mine = np.repeat(row, copies), np.repeat(block, copies), np.repeat(mine, copies)
        return row, self.first[block] + (mine * self.splits[block] + rank if data else rank * self.splits[block] + mine)

    def data(self, tree: np.ndarray, leaf: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and group of each data row's copies."""
        return self._spread(tree, leaf, hashed, True)

    def queries(self, tree: np.ndarray, leaf: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and group of each query's copies."""
        return self._spread(tree, leaf, hashed, False)


def nearest_vectors(
    queries: DataFrame, data: DataFrame, query_id: str, data_id: str, dims: Sequence[str], k: int, rows: int | None = None,
    trees: int = 3, leaf_size: int = 128, visits: int = 8, sample_size: int = 200_000, exact: bool = True, max_depth: int = 14, group_rows: int = 8_192,
) -> DataFrame:
    """For each query the ``k`` data rows nearest in Euclidean distance: ``query_id, data_id, d2, rank``.

    Equal distances go by smaller data id. Queries and data carry the coordinates ``dims``. Rows with a NULL id or a
    NULL, NaN or infinite coordinate are left out on either side. A repeated row (same id and place) counts once; a query
    gets fewer than ``k`` rows only if the data have fewer; an empty side gives none; other columns are ignored. ``rows``: roughly
    the number of data rows, counted if None. Without ``exact`` the answer is that of the queue search alone.

    Queries at one place are searched once. Of data rows at one place only the ``k`` smallest ids can be among the nearest,
    so the rest are set aside before the index is filled, which bounds the leaves however many rows share a place. The data are filed
    once; only rows in leaves that some query visits are shuffled, into groups of about ``group_rows`` rows and queries (see ``Groups``).
    """
    spark = ship(data.sparkSession)
    dims = list(dims)
    if query_id == data_id:
        raise ValueError("query_id and data_id must differ")

    def clean(df: DataFrame, key: str) -> DataFrame:
        ok = F.col(key).isNotNull()
        for c in dims:
            ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
        return df.filter(ok).select(F.col(key), *(F.col(c) + F.lit(0).cast(df.schema[c].dataType) for c in dims)).toDF(key, *dims)

    data, queries = clean(data, data_id), clean(queries, query_id)
    if rows is None:
        rows = data.count()
    part = data.select(*(F.col(c).cast("double") for c in dims))
    part = part.sample(fraction=sample_size / rows, seed=5) if rows > sample_size else part
    sample = part.limit(2 * sample_size).toPandas().to_numpy(np.float64).reshape(-1, len(dims))
    forest = fit_forest(sample, rows, trees, leaf_size, max_depth)
    shared = spark.sparkContext.broadcast(forest)  # at most 2**max_depth nodes a tree

    spot = Window.partitionBy(*dims).orderBy(data_id)
    data = data.withColumn("__r", F.dense_rank().over(spot)).filter(F.col("__r") <= k).drop("__r").dropDuplicates([data_id, *dims])

    leaf_type = T.StructType([T.StructField(f"l{t}", T.IntegerType()) for t in range(trees)])

    @F.pandas_udf(leaf_type)
    def leaves_of(*columns: pd.Series) -> pd.DataFrame:
        v = np.stack([c.to_numpy(np.float64) for c in columns], axis=1)
        return pd.DataFrame(shared.value.file(v), columns=leaf_type.fieldNames())

    hashed = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 31)).alias("__h")
    filed = materialize(data.withColumn("__l", leaves_of(*dims)).select(data_id, *dims, "__l.*", hashed(data_id)))
    places = materialize(queries.select(*dims).distinct().select("*", hashed(*dims)))
    marks = [T.StructField("__t", T.IntegerType()), T.StructField("__leaf", T.IntegerType())]
    visit_schema = T.StructType([*places.schema.fields, *marks])
    weights = held_in_leaves(forest, sample) * (rows / max(1, len(sample)))

    def visiting(batches: Iterator[pd.DataFrame], bounded: bool) -> Iterator[pd.DataFrame]:
        forest = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 2048):
                b = whole.iloc[lo : lo + 2048]
                v = b[dims].to_numpy(np.float64)
                row, tree, leaf = forest.search(v, visits)
                if bounded:
                    near, at = forest.within(v, np.sqrt(b["__r2"].to_numpy(np.float64)))
                    old = row[tree == 0].astype(np.int64) * forest.leaves + leaf[tree == 0]
                    more = ~np.isin(near * forest.leaves + at, old)
                    row, leaf = near[more], at[more]
                    tree = np.zeros(len(row), np.int32)
                yield b[[*dims, "__h"]].iloc[row].assign(__t=tree, __leaf=leaf)

    candidate_schema = T.StructType([*(places.schema[c] for c in dims), T.StructField(data_id, data.schema[data_id].dataType), T.StructField("d2", T.DoubleType())])

    def ranked(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return asked[dims].iloc[:0].assign(**{data_id: held[data_id].iloc[:0], "d2": np.zeros(0)})
        held = held.iloc[np.argsort(held["__leaf"].to_numpy(), kind="stable")]
        leaf, ids, v = held["__leaf"].to_numpy(), held[data_id].to_numpy(), held[dims].to_numpy(np.float64)
        order = np.argsort(asked["__leaf"].to_numpy(), kind="stable")
        wanted, q = asked["__leaf"].to_numpy()[order], asked[dims].to_numpy(np.float64)
        rows, found, near = [order[:0]], [np.zeros(0, np.int64)], [np.zeros(0)]
        edges = np.flatnonzero(np.diff(wanted, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            lo, hi = np.searchsorted(leaf, [wanted[a], wanted[a] + 1])
            if lo == hi:
                continue
            some = max(1, 4_000_000 // (hi - lo))
            for i in range(a, b, some):
                own = order[i : min(i + some, b)]
                d2 = np.zeros((len(own), hi - lo))
                for j in range(len(dims)):
                    d2 += (q[own, j, None] - v[None, lo:hi, j]) ** 2
                if hi - lo > k:  # everything up to the k-th distance stays, ties included
                    r, c = np.nonzero(d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k])
                else:
                    r, c = np.nonzero(np.ones_like(d2, bool))
                rows.append(own[r])
                found.append(lo + c)
                near.append(d2[r, c])
        return asked[dims].iloc[np.concatenate(rows)].assign(**{data_id: ids[np.concatenate(found)], "d2": np.concatenate(near)})

    def best(df: DataFrame) -> DataFrame:
        once = df.groupBy(*dims, data_id).agg(F.min("d2").alias("d2"))  # several trees may give the same row
        order = Window.partitionBy(*dims).orderBy("d2", data_id)
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    group = [marks[1], T.StructField("__g", T.LongType())]
    entry = T.StructType([*filed.schema.fields[: 1 + len(dims)], *group])
    question = T.StructType([*(places.schema[c] for c in dims), *group])

    def probe(asked: DataFrame, used: int) -> DataFrame:
        """Candidates of the visits ``asked`` (written out) in the first ``used`` trees."""
        count = asked.groupBy("__t", "__leaf").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most one row a leaf
        if not len(count):
            return spark.createDataFrame([], candidate_schema)
        wanted = np.zeros((used, forest.leaves), np.int64)
        wanted[count["__t"], count["__leaf"]] = count["n"]
        groups, leaves = spark.sparkContext.broadcast(Groups(weights[:used], wanted, group_rows)), forest.leaves

        def to_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                tree, leaf = b["__t"].to_numpy(), b["__leaf"].to_numpy()
                row, group = groups.value.queries(tree, leaf, b["__h"].to_numpy())
                yield b[dims].iloc[row].assign(__leaf=(tree * leaves + leaf).astype(np.int32)[row], __g=group)

        def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for t in range(used):
                    leaf = b[f"l{t}"].to_numpy()
                    row, group = groups.value.data(np.full(len(b), t), leaf, b["__h"].to_numpy())
                    yield b[[data_id, *dims]].iloc[row].assign(__leaf=leaf[row] + np.int32(t * leaves), __g=group)

        q = asked.mapInPandas(to_groups, question)
        return q.groupBy("__g").cogroup(filed.mapInPandas(entries, entry).groupBy("__g")).applyInPandas(ranked, candidate_schema)

    first = best(probe(materialize(places.mapInPandas(lambda it: visiting(it, False), visit_schema)), trees))
    if exact:
        first = materialize(first)
        bound = first.groupBy(*dims).agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).otherwise(float("inf")).alias("__r2"))
        asked = places.join(bound, dims, "left").select(*dims, "__h", F.coalesce("__r2", F.lit(float("inf"))).alias("__r2"))
        more = probe(materialize(asked.mapInPandas(lambda it: visiting(it, True), visit_schema)), 1)
        first = best(first.select(*dims, data_id, "d2").unionByName(more))
    return queries.dropDuplicates([query_id, *dims]).join(first, dims).select(query_id, data_id, "d2", "rank")
