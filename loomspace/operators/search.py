"""Range search, nearest neighbours of one place, and lookups.

Everything is a filter, an aggregate or a top-k over plain columns, so predicates and column lists reach the Parquet reader and
the top-k keeps k rows per task. Rows with a NULL or NaN coordinate match no box; an inverted or non-finite box matches nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspace.functions import geometry as G

Corners = tuple[float, float, float, float]


def _usable(box: Corners) -> bool:
    return all(map(math.isfinite, box)) and box[0] <= box[2] and box[1] <= box[3]


def range_filter(df: DataFrame, box: Corners, predicate: Column | None = None, x: str = "x", y: str = "y", distinct_key: bool = False) -> DataFrame:
    """Rows whose place lies in the closed box and that pass the predicate; one row for each place with ``distinct_key``."""
    if not _usable(box):
        return df.limit(0)
    out = df.filter(G.contains(G.box(*box), G.Point(F.col(x), F.col(y))))
    out = out if predicate is None else out.filter(predicate)
    return out.dropDuplicates([x, y]) if distinct_key else out


def text_search(df: DataFrame, box: Corners, text: str, folded: list[str], raw: list[str] = [], x: str = "x", y: str = "y") -> DataFrame:
    """Range search joined with a word test (see ``geometry.mentions``)."""
    return range_filter(df, box, G.mentions(F.col(text), folded, raw), x, y)


def search_intersecting(df: DataFrame, box: Corners, predicate: Column | None = None, columns: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Rows whose own rectangle touches the box."""
    if not _usable(box):
        return df.limit(0)
    out = df.filter(G.intersects(G.Box(*(F.col(c) for c in columns)), G.box(*box)))
    return out if predicate is None else out.filter(predicate)


def search_point(df: DataFrame, px: float, py: float, x: str = "x", y: str = "y") -> DataFrame:
    """All rows exactly at a place."""
    return df.filter((F.col(x) == F.lit(px).cast("float")) & (F.col(y) == F.lit(py).cast("float")))


def fold_search(df: DataFrame, box: Corners, *aggregates: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Aggregates over the rows in the box; one row, as any global aggregate."""
    return range_filter(df, box, None, x, y).agg(*aggregates)


def range_count(df: DataFrame, box: Corners, x: str = "x", y: str = "y") -> DataFrame:
    return fold_search(df, box, F.count(F.lit(1)).alias("n"), x=x, y=y)


def contains_entries(entries: DataFrame, data: DataFrame, columns: list[str]) -> DataFrame:
    """The entries that the data hold with equal values in all ``columns`` (NULL equals NULL)."""
    on = F.lit(True)
    for c in columns:
        on = on & entries[c].eqNullSafe(data[c])
    return entries.join(data.select(*columns), on, "left_semi")


def knn_filter(df: DataFrame, px: float, py: float, k: int, predicate: Column | None = None, tie: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """The ``k`` rows nearest to a place with ``dist``, equal distances by ``tie``; the predicate goes first.

    All rows if there are fewer than ``k``; none for ``k`` < 1. Rows without finite coordinates are left out.
    """
    if k < 1:
        return df.withColumn("dist", F.lit(0.0)).limit(0)
    p = G.Point(F.col(x), F.col(y))
    out = df.filter(G.is_finite(p))
    out = out if predicate is None else out.filter(predicate)
    return out.withColumn("dist", G.distance(p, G.point(px, py))).orderBy("dist", tie).limit(k)


def nearest(df: DataFrame, px: float, py: float, tie: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    return knn_filter(df, px, py, 1, None, tie, x, y)


def knn_distinct(df: DataFrame, px: float, py: float, k: int, key: str = "id", predicate: Column | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """``knn_filter`` over a table in which a key may be repeated: the ``k`` nearest keys, each with the least of its other columns.

    Copies of a key must share their place and agree on the predicate. No row is shuffled but the nearest few of each task: the query takes
    the nearest ``2 * k`` rows, and more (a small job each time) until they hold ``k`` keys.
    """
    most = 2 * max(k, 1)
    while True:
        near = knn_filter(df, px, py, most if k >= 1 else 0, predicate, key, x, y)
        rows, keys = near.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
        if keys >= k or rows < most:
            break
        most *= 4
    once = near.groupBy(key).agg(*(F.min(c).alias(c) for c in near.columns if c != key))
    return once.select(*near.columns).orderBy("dist", key).limit(max(k, 0))


def hilbert_filter(df: DataFrame, index: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows whose curve index lies in one of the ranges (inclusive), as comparisons that reach the reader of data sorted by it."""
    keep = F.lit(False)
    for a, b in ranges:
        keep = keep | F.col(index).between(a, b)
    return df.filter(keep)
