"""Queries of the data problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspace.functions.wkt import placed, with_geometry
from loomspace.operators.hot_keys import frequent_keys, key_totals, one_row_per_id
from loomspace.operators.proximity import region_join
from loomspace.plans.runtime import table


def entry_points(spark: SparkSession, folder: str) -> DataFrame:
    """entry_id, x, y, value of each entry with a readable point, each id once."""
    raw = with_geometry(table(spark, folder, "entries").select("entry_id", "geom", "value"), "geom", points_only=True)
    return one_row_per_id(raw, "entry_id", {"x": F.col("geometry.x1"), "y": F.col("geometry.y1"), "value": F.col("value")})


def box_edges(spark: SparkSession, folder: str) -> DataFrame:
    """x of each box with a finite left edge, each id once."""
    raw = table(spark, folder, "boxes").select("box_id", "x").filter("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')")
    return one_row_per_id(raw, "box_id", {"x": F.col("x") + F.lit(0).cast("float")})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The locations and left edges that hold at least 2 % of the rows."""
    places = frequent_keys(entry_points(spark, folder), ["x", "y"], 0.02)
    edges = frequent_keys(box_edges(spark, folder), ["x"], 0.02)
    k = lambda c: (F.col(c).cast("double") * 64).cast("long")
    return places.select(F.lit("entry_geom").alias("field"), k("x").alias("kx"), k("y").alias("ky")).unionByName(
        edges.select(F.lit("box_x").alias("field"), k("x").alias("kx"), F.lit(0).cast("long").alias("ky"))
    )


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Row count and sum of the values for every location and every left edge."""
    value = F.when(~F.isnan("value"), F.col("value"))
    places = key_totals(entry_points(spark, folder), ["x", "y"], {"rows": F.count(F.lit(1)), "total": F.round(F.sum(value), 2)})
    edges = key_totals(box_edges(spark, folder), ["x"], {"rows": F.count(F.lit(1))})
    d = lambda c: F.col(c).cast("double")
    return places.select(F.lit("entry_geom").alias("field"), d("x").alias("x"), d("y").alias("y"), "rows", "total").unionByName(
        edges.select(F.lit("box_x").alias("field"), d("x").alias("x"), F.lit(None).cast("double").alias("y"), "rows", F.lit(None).cast("double").alias("total"))
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Points in boxes, points near stations and entries in boxes."""
    finite = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in ("x", "y", "x2", "y2"))
    boxes = table(spark, folder, "boxes").filter(finite).filter("x <= x2 AND y <= y2").select(F.col("box_id").alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    raw_points, raw_entries = table(spark, folder, "points"), table(spark, folder, "entries")
    points = raw_points.filter(placed(F.col("x"), F.col("y"))).select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    entries = with_geometry(raw_entries.select(F.col("entry_id").alias("id"), "geom"), "geom").select("id", "geometry.x1", "geometry.y1", "geometry.x2", "geometry.y2")
    stations = table(spark, folder, "stations").filter(placed(F.col("x"), F.col("y"))).select(F.col("station_id").alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    n_points, n_entries = raw_points.count(), raw_entries.count()
    pairs = [
        region_join(boxes, points, "contains", rows=n_points).withColumn("kind", F.lit("box")),
        region_join(stations, points, "within", distance=0.15625, rows=n_points).withColumn("kind", F.lit("near")),
        region_join(boxes, entries, "contains", rows=n_entries).withColumn("kind", F.lit("entry")),
    ]
    out = pairs[0].unionByName(pairs[1]).unionByName(pairs[2])
    return out.select("kind", "left_id", "right_id")
