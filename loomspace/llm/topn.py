"""The N highest-scoring items of every group, by salted ranking in two stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, groups: Sequence[str], score: str, item: str, n: int, salts: int = 64, agreeing: bool = False) -> DataFrame:
    """For each group the ``n`` distinct items of highest score, equal scores by smaller item.

    Returns ``groups..., item, score, rank`` (rank from 1). Stage one hashes each group into ``salts`` subgroups by item and
    keeps the ``n`` best of each; stage two ranks the survivors, at most ``n * salts`` of a group. Both stages use group-limited
    windows, which cut rows before they are shuffled, so a group with a third of all rows is spread over ``salts`` tasks.

    Rows with a NULL group, item or score or a NaN score don't take part. Repeated rows (same group, item and score)
    count once; an item that has several scores in a group counts with its highest, to which a first aggregation folds it. With
    ``agreeing`` the caller warrants that copies of an item agree in score, and that aggregation, a shuffle of all items, is left out. Fewer than ``n`` items: all come out.
    Empty input or ``n`` < 1: no rows. Other columns are ignored, whatever their names.
    """
    kept = df.select(*groups, F.col(item), F.col(score))
    for c in [*groups, item, score]:
        kept = kept.filter(F.col(c).isNotNull())
    kept = kept.filter(~F.isnan(F.col(score).cast("double")) & F.lit(n >= 1))
    if not agreeing:  # else an item's lower scores would take ranks of other items
        kept = kept.groupBy(*groups, item).agg(F.max(score).alias(score))
    best = [F.col(score).desc(), F.col(item).asc()]
    salt = F.pmod(F.xxhash64(item), F.lit(salts)).cast("int")
    # copies of an item share a subgroup and a dense rank: up to n distinct items stay
    inner = Window.partitionBy(*groups, "__salt").orderBy(*best)
    pairs = kept.withColumn("__salt", salt).withColumn("__r", F.dense_rank().over(inner)).filter(F.col("__r") <= n)
    once = pairs.groupBy(*groups, item).agg(F.max(score).alias(score))
    outer = Window.partitionBy(*groups).orderBy(*best)
    return once.withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= n)
