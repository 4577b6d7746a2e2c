"""Per-key results when a few keys hold most records.

All aggregates are algebraic and native, so every map task first folds its rows into one small state per key (Tungsten's
bounded hash table, which spills to a sort) and only those states are shuffled. A key with a third of all rows reaches
its reducer as one state per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspace.plans.runtime import materialize


def one_row_per_id(df: DataFrame, id_col: str, columns: dict[str, Column]) -> DataFrame:
    """One row for each id with the least of each column's values.

    Rows with a NULL id are left out. Repeated ids that agree come out unchanged; where they differ, the least value of each
    column stands (NULL only if all are). An empty input gives no rows.
    """
    return df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(*(F.min(c).alias(n) for n, c in columns.items()))


def key_totals(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Algebraic aggregates for each key, combined on the map side.

    ``aggregates`` may use count, sum, min, max, avg and their like. Rows with a NULL in any key are left out; an empty input
    gives no row; columns that are neither key nor aggregate don't matter, whatever their names.
    """
    kept = df
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    return kept.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items()))


def frequent_keys(df: DataFrame, keys: Sequence[str], share: float, count: str = "n") -> DataFrame:
    """The keys that hold at least ``share`` of the rows with a key, with their row counts.

    The totals are written once and read twice (for their sum and for the answer), since the sum isn't known before.
    No row for an empty input. ``share`` of 0 gives all keys.
    """
    totals = materialize(key_totals(df, keys, {count: F.count(F.lit(1))}))
    rows = totals.agg(F.sum(count)).first()[0] or 0
    return totals.filter(F.col(count) >= F.lit(share * rows))
