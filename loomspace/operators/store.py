"""A keyed store of places on plain DataFrames: every update gives a new DataFrame.

The key is the pair of coordinates (or any columns named by ``keys``); the other columns are values. Keys compare as NULL-safe
equal, so a row with a NULL key is addressable too. Large sides are joined by key with one shuffle each; only Spark's own
size estimate may turn a join into a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("x", "y")


def _on(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def build(df: DataFrame, order: str, keys: tuple[str, ...] = KEYS, partitions: int | None = None) -> DataFrame:
    """One row for each key, the one with the least ``order``; optionally spread by key over so many partitions."""
    window = Window.partitionBy(*keys).orderBy(order)
    one = df.withColumn("__r", F.row_number().over(window)).filter("__r = 1").drop("__r")
    return one if partitions is None else one.repartition(partitions, *keys)


def build_with_partitioner(df: DataFrame, part: Column, partitions: int) -> DataFrame:
    """Spread by a given partition column, as a skew-aware join wants it."""
    return df.repartition(partitions, part)


def multiput(store: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS, merge: Callable[[str, Column, Column], Column] | None = None, fresh: Callable[[str, Column], Column] | None = None) -> DataFrame:
    """Upsert. ``merge(name, old, new)`` gives a value where the key is known (default: the new one), ``fresh(name, new)`` where not.

    ``new`` must hold each key once (``build`` sees to it); all columns of the store must be in ``new``. An empty side leaves the
    other as it is (fresh values included).
    """
    values = [c for c in store.columns if c not in keys]
    s, n = store.withColumn("__s", F.lit(True)).alias("s"), new.select(*store.columns).withColumn("__n", F.lit(True)).alias("n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
    merge = merge or (lambda name, old, new: new)
    fresh = fresh or (lambda name, new: new)
    known, added = F.col("s.__s").isNotNull(), F.col("n.__n").isNotNull()
    out = []
    for c in store.columns:
        old, fresh_value = F.col(f"s.{c}"), F.col(f"n.{c}")
        if c in values:
            out.append(F.when(known & added, merge(c, old, fresh_value)).when(added, fresh(c, fresh_value)).otherwise(old).alias(c))
        else:
            out.append(F.when(known, old).otherwise(fresh_value).alias(c))
    return s.join(n, on, "full_outer").select(*out)


def put(store: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Overwrite or add the rows of ``new``."""
    return multiput(store, new, keys)


def get(store: DataFrame, **key: object) -> DataFrame:
    """Rows of one key; no row if it is missing. Float columns compare in single precision."""
    out = store
    for k, v in key.items():
        out = out.filter(F.col(k).eqNullSafe(F.lit(v).cast(store.schema[k].dataType)))
    return out


def multiget(store: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows whose key is among ``wanted``; each row once, however often its key is wanted."""
    return store.join(wanted, _on(store, wanted, keys), "left_semi")


def delete(store: DataFrame, gone: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The store without the keys of ``gone``."""
    return store.join(gone, _on(store, gone, keys), "left_anti")


def insert_all(store: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows (a bag: nothing is merged)."""
    return store.unionByName(new)


def remove_all(store: DataFrame, gone: DataFrame) -> DataFrame:
    """Takes away one equal row for each row of ``gone``; key and values must agree."""
    return store.exceptAll(gone.select(*store.columns))


def insert_merged(df: DataFrame, keys: tuple[str, ...] = KEYS, **aggregates: Column) -> DataFrame:
    """One row for each key with merged values; aggregates are combined on the map side."""
    return df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items()))


def map_values(store: DataFrame, **columns: Column) -> DataFrame:
    return store.withColumns(columns)


def values(store: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return store.select(*(c for c in store.columns if c not in keys))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two stores holds, as a bag; empty if the stores are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
