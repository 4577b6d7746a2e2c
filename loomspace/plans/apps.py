"""Whole programs over text files: ``python -m loomspace.plans.apps range-join POINTS BOXES`` and so on."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspace.operators.joins import rjoin
from loomspace.operators.knn import knn_join
from loomspace.operators.search import knn_filter, text_search
from loomspace.plans.runtime import ship, spark_session
from loomspace.sources import readers


def _numbered(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def range_join(spark: SparkSession, points: str, boxes: str) -> DataFrame:
    """Places per rectangle, for files of WKT points and WKT polygons."""
    return rjoin(_numbered(readers.read_wkt_points(spark, points), "id"), _numbered(readers.read_wkt_boxes(spark, boxes), "bid"), "bid", {"n": F.count(F.lit(1))}, {"n": F.lit(0)})


def nearest_join(spark: SparkSession, points: str, queries: str, k: int) -> DataFrame:
    """The ``k`` nearest places of each query, for files of WKT points."""
    asked = _numbered(readers.read_wkt_query_points(spark, queries), "qid").withColumnsRenamed({"x": "qx", "y": "qy"})
    return knn_join(_numbered(readers.read_wkt_points(spark, points), "id"), asked, k)


def text_range(spark: SparkSession, lines: str, box: tuple[float, float, float, float], words: list[str]) -> DataFrame:
    """Lines ``latitude,longitude,text`` in a box that mention one of the words."""
    return text_search(readers.read_lat_lon_text(spark, lines), box, "value", [w.lower() for w in words])


def nearest_of(spark: SparkSession, lines: str, x: float, y: float, k: int) -> DataFrame:
    """The ``k`` lines ``latitude,longitude,text`` nearest to a place."""
    return knn_filter(readers.read_lat_lon_text(spark, lines), x, y, k, tie="value")


def main() -> None:
    cli = argparse.ArgumentParser(description=__doc__)
    sub = cli.add_subparsers(dest="app", required=True)
    for name, files in (("range-join", ("points", "boxes")), ("nearest-join", ("points", "queries"))):
        p = sub.add_parser(name)
        for f in files:
            p.add_argument(f)
        p.add_argument("--k", type=int, default=10)
    args = cli.parse_args()
    spark = ship(spark_session())
    began = time.time()
    out = range_join(spark, args.points, args.boxes) if args.app == "range-join" else nearest_join(spark, args.points, args.queries, args.k)
    print(f"{out.count()} rows in {time.time() - began:.1f} s")
    spark.stop()


if __name__ == "__main__":
    main()
