"""Text sources and sinks of places and rectangles. Malformed lines are dropped, never raised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspace.functions.wkt import format_point, wkt_point, wkt_ring_corners


def read_wkt_points(spark: SparkSession, path: str, value: str = "1") -> DataFrame:
    """``x, y, value`` of each line that is a WKT point."""
    p = spark.read.text(path).select(wkt_point(F.col("value"), None).alias("p")).filter("p IS NOT NULL")
    return p.select(F.col("p.x1").alias("x"), F.col("p.y1").alias("y"), F.lit(value).alias("value"))


def read_wkt_query_points(spark: SparkSession, path: str) -> DataFrame:
    """``x, y`` of each line that is a WKT point."""
    return read_wkt_points(spark, path).select("x", "y")


def read_wkt_boxes(spark: SparkSession, path: str) -> DataFrame:
    """``x1, y1, x2, y2`` of each line that is a WKT polygon: ring coordinates 0 and 2 as they stand, in no order."""
    g = spark.read.text(path).select(wkt_ring_corners(F.col("value")).alias("g")).filter("g IS NOT NULL AND NOT g.is_point")
    return g.select("g.x1", "g.y1", "g.x2", "g.y2")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", ",").alias("f"))


def _numbers(df: DataFrame, x: int, y: int) -> DataFrame:
    at = lambda i: F.trim(F.get("f", F.lit(i))).try_cast("float")
    return df.select("f", at(x).alias("x"), at(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")


def read_lat_lon_text(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, value`` of lines ``latitude,longitude,text``: x is the longitude."""
    return _numbers(_fields(spark, path), 1, 0).filter(F.size("f") >= 3).select("x", "y", F.get("f", F.lit(2)).alias("value"))


def read_xy_text(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, value`` of lines ``x,y`` or ``x,y,text``; a missing text reads ``xxxx``."""
    return _numbers(_fields(spark, path), 0, 1).select("x", "y", F.coalesce(F.get("f", F.lit(2)), F.lit("xxxx")).alias("value"))


def write_wkt(df: DataFrame, path: str, x: str = "x", y: str = "y") -> None:
    """One WKT point a line; rows without a coordinate are left out."""
    df.select(format_point(F.col(x), F.col(y)).alias("value")).filter("value IS NOT NULL").write.mode("errorifexists").text(path)


def csv_to_wkt(spark: SparkSession, source: str, target: str) -> None:
    """Lines ``latitude,longitude[,…]`` as WKT points."""
    f = _fields(spark, source).filter(F.size("f") >= 2)
    text = F.concat(F.lit("POINT("), F.trim(F.get("f", F.lit(1))), F.lit(" "), F.trim(F.get("f", F.lit(0))), F.lit(")"))
    f.select(text.alias("value")).write.mode("errorifexists").text(target)


def sample_and_rewrite(spark: SparkSession, source: str, target: str, fraction: float, partitions: int, seed: int = 1) -> None:
    """A sample of whitespace-separated lines as ``third,second,first``, in ``partitions`` files."""
    f = spark.read.text(source).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") >= 3)
    lines = f.select(F.concat_ws(",", F.get("f", F.lit(2)), F.get("f", F.lit(1)), F.get("f", F.lit(0))).alias("value"))
    lines.sample(fraction=fraction, seed=seed).repartition(partitions).write.mode("errorifexists").text(target)


def from_rows(spark: SparkSession, rows: list[tuple[float, float, str]]) -> DataFrame:
    """``x, y, value`` from memory."""
    return spark.createDataFrame(rows, "x float, y float, value string")
