"""What a physical plan holds, for tests and for reading plans at the prompt."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    conf, name = df.sparkSession.conf, "spark.sql.maxMetadataStringLength"
    before = conf.get(name)
    conf.set(name, "100000")  # else long lists of filters are cut
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set(name, before)


def exchanges(df: DataFrame) -> int:
    """Shuffles and broadcasts of the plan before it runs."""
    return len(re.findall(r"(?<!Reused)\b(?:Exchange|BroadcastExchange)\b", plan_text(df)))


def shuffles(df: DataFrame) -> int:
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)\bExchange (?:hash|range|Single|RoundRobin)", plan_text(df)))


def nested_loops(df: DataFrame) -> int:
    return len(re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan_text(df)))


def pushed_filters(df: DataFrame) -> str:
    return " ".join(re.findall(r"PushedFilters: \[(.*?)(?:\]|\.\.\.)", plan_text(df)))


def read_columns(df: DataFrame) -> list[str]:
    return re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<(.*?)>", plan_text(df))))
