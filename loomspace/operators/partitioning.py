"""Quadtree partitioning: leaves from a sample, leaf counts, packing of leaves into partitions, packing by query load."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspace.operators.quadtree import DEPTH, Quadtree, build_quadtree, sample_places
from loomspace.operators.search import range_filter
from loomspace.plans.runtime import ship


def quadtree_for(df: DataFrame, partitions: int, rows: int | None = None, x: str = "x", y: str = "y", max_leaves: int = 4096, sample_size: int = 100_000) -> Quadtree:
    """A tree whose leaves hold at most about a quarter of a partition's share of the rows."""
    rows = df.count() if rows is None else rows
    return build_quadtree(*sample_places(df, x, y, rows, sample_size), leaf_share=1 / (4 * partitions), max_leaves=max_leaves)


def with_leaf(df: DataFrame, tree: Quadtree, x: str = "x", y: str = "y") -> DataFrame:
    """With the leaf of each place; leaves are half-open, so there is exactly one."""
    shared = ship(df.sparkSession).sparkContext.broadcast(tree)

    @F.pandas_udf(T.IntegerType())
    def leaf(px: pd.Series, py: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaf(px.to_numpy(), py.to_numpy()).astype(np.int32))

    return df.withColumn("leaf", leaf(x, y))


def box_leaves(boxes: DataFrame, tree: Quadtree, columns: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """One row for each leaf that a box touches; inverted or undefined boxes touch none."""
    shared = ship(boxes.sparkSession).sparkContext.broadcast(tree)
    a, b, c, d = columns
    sane = boxes.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) <= F.col(c)) & (F.col(b) <= F.col(d)) & ~F.isnan(F.col(c).cast("double")) & ~F.isnan(F.col(d).cast("double")))

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at, leaf = shared.value.cover(*(rows[n].to_numpy(np.float64) for n in columns))
            yield rows.iloc[at].assign(leaf=leaf.astype(np.int32))

    return sane.mapInPandas(cover, T.StructType([*boxes.schema.fields, T.StructField("leaf", T.IntegerType())]))


def leaf_counts(df: DataFrame, tree: Quadtree, x: str = "x", y: str = "y") -> DataFrame:
    return with_leaf(df, tree, x, y).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))


def query_visits(boxes: DataFrame, tree: Quadtree) -> DataFrame:
    """How many boxes touch each leaf."""
    return box_leaves(boxes, tree).groupBy("leaf").agg(F.count(F.lit(1)).alias("visits"))


def pack_leaves(weights: np.ndarray, partitions: int) -> np.ndarray:
    """Partition of each leaf: neighbouring leaves (in curve order) together, each partition up to its share of the weight."""
    total = float(weights.sum()) or 1.0
    before = np.concatenate([[0.0], np.cumsum(weights)[:-1]])
    return np.minimum(partitions - 1, np.floor(before / total * partitions)).astype(np.int64)


def pack_by_load(counts: np.ndarray, visits: np.ndarray, partitions: int) -> np.ndarray:
    """Partition of each leaf when it costs ``(visits + 1) * count``: the dearest leaf first, always to the least loaded partition."""
    out, heap = np.zeros(len(counts), np.int64), [(0.0, p) for p in range(partitions)]
    for i in np.argsort(-(visits + 1) * counts, kind="stable"):
        load, p = heapq.heappop(heap)
        out[i] = p
        heapq.heappush(heap, (load + float((visits[i] + 1) * counts[i]), p))
    return out


def partition_of_leaves(spark: SparkSession, pids: np.ndarray) -> DataFrame:
    """``leaf, pid`` as a small table (at most one row for each leaf)."""
    return spark.createDataFrame(pd.DataFrame({"leaf": np.arange(len(pids), dtype=np.int32), "pid": pids.astype(np.int32)}))


def repartition_by_quadtree(df: DataFrame, tree: Quadtree, partitions: int, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of a partition lie together: ``pid`` is added, the data are spread by it and sorted by leaf, for min/max pruning on disk."""
    pids = pack_leaves(tree.weight, partitions)
    mapping = F.broadcast(partition_of_leaves(df.sparkSession, pids))
    return with_leaf(df, tree, x, y).join(mapping, "leaf").repartition(partitions, "pid").sortWithinPartitions("leaf")


def write_layout(df: DataFrame, tree: Quadtree, partitions: int, path: str, x: str = "x", y: str = "y") -> None:
    """Write ``df`` so that a range search reads only where it can find something: a folder for each partition of neighbouring leaves,
    rows sorted by leaf within it, and beside them the table ``layout`` of each folder's bounding box."""
    spread = repartition_by_quadtree(df, tree, partitions, x, y)
    spread.write.partitionBy("pid").parquet(f"{path}/rows")
    written = df.sparkSession.read.parquet(f"{path}/rows")
    written.groupBy("pid").agg(*(f(F.col(c).cast("double")).alias(n) for f, c, n in ((F.min, x, "x1"), (F.min, y, "y1"), (F.max, x, "x2"), (F.max, y, "y2")))).coalesce(1).write.parquet(f"{path}/layout")


def read_layout(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """A table of ``write_layout``; with a ``box`` only the places in it, out of the folders whose bounding box it touches."""
    rows = spark.read.parquet(f"{path}/rows")
    if box is None:
        return rows.drop("pid", "leaf")
    x1, y1, x2, y2 = box
    wanted = [r[0] for r in spark.read.parquet(f"{path}/layout").filter((F.col("x1") <= x2) & (F.col("x2") >= x1) & (F.col("y1") <= y2) & (F.col("y2") >= y1)).select("pid").collect()]  # at most one a folder
    return range_filter(rows.filter(F.col("pid").isin(wanted)), box, None, x, y).drop("pid", "leaf")


def leaf_audit(df: DataFrame, tree: Quadtree, most: int, x: str = "x", y: str = "y") -> DataFrame:
    """One row: places, those outside the rectangle of their leaf, and leaves with more than ``most`` places that could still be divided."""
    box = tree.bounds()
    corners = df.sparkSession.createDataFrame(pd.DataFrame({"leaf": np.arange(len(tree), dtype=np.int32), "level": tree.levels, **{n: [b[i] for b in box] for i, n in enumerate(("bx1", "by1", "bx2", "by2"))}}))
    at = with_leaf(df.select(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), x, y), tree, x, y).join(F.broadcast(corners), "leaf")
    top = tree.extent[2:]
    out = (F.col("px") < F.col("bx1")) | (F.col("py") < F.col("by1")) | ((F.col("px") >= F.col("bx2")) & (F.col("bx2") < top[0])) | ((F.col("py") >= F.col("by2")) & (F.col("by2") < top[1]))
    each = at.groupBy("leaf", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(out.cast("long")).alias("out"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("places"), F.coalesce(F.sum("out"), F.lit(0)).alias("outside"), F.coalesce(F.sum(((F.col("n") > most) & (F.col("level") < DEPTH)).cast("long")), F.lit(0)).alias("overfull"))
