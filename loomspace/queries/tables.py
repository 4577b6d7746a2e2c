"""Queries of the text sources and sinks, the spatial layout on disk, and the ways of spreading a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.operators import grid as grids
from loomspace.operators import kmeans, knn, partitioning, search, skew, store
from loomspace.plans.runtime import scratch
from loomspace.queries.spatial import BOX, boxes, places, points, wide, xy
from loomspace.queries.spatial_sql import XY, B, P, S, cells, inside
from loomspace.sources import generators, readers

Q = SparkSession


def wkt_file_points(spark: Q, d: str) -> DataFrame:
    """Places written as WKT lines and read again, among lines that are no points."""
    at = scratch(spark)
    readers.write_wkt(points(spark, d), at)
    points(spark, d).filter("id % 50 = 0").select(F.concat(F.lit("POINT("), F.col("x").cast("string")).alias("value")).write.mode("append").text(at)
    return wide(readers.read_wkt_points(spark, at)).groupBy("x", "y", "value").agg(F.count(F.lit(1)).alias("n"))


def wkt_file_queries(spark: Q, d: str) -> DataFrame:
    at = scratch(spark)
    readers.write_wkt(places(spark, d), at, "qx", "qy")
    return wide(readers.read_wkt_query_points(spark, at)).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def wkt_file_boxes(spark: Q, d: str) -> DataFrame:
    """Boxes written as polygons, corners in any order, and read as they stand."""
    at, c = scratch(spark), lambda x, y: F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))
    ring = F.concat_ws(", ", c("x1", "y1"), c("x2", "y1"), c("x2", "y2"), c("x1", "y2"), c("x1", "y1"))
    boxes(spark, d).select(F.concat(F.lit("POLYGON(("), ring, F.lit("))")).alias("value")).write.text(at)
    return wide(readers.read_wkt_boxes(spark, at)).groupBy("x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("n"))


def _csv(df: DataFrame, *columns: str) -> str:
    at = scratch(df.sparkSession)
    df.select(F.concat_ws(",", *(F.col(c).cast("string") for c in columns)).alias("value")).write.text(at)
    return at


def _tagged(spark: Q, d: str) -> DataFrame:
    return points(spark, d).select("id", "x", "y", F.coalesce(F.regexp_replace("tag", "[,\\r\\n]", " "), F.lit("none")).alias("tag"))


def csv_lat_lon_text(spark: Q, d: str) -> DataFrame:
    got = readers.read_lat_lon_text(spark, _csv(_tagged(spark, d), "y", "x", "tag"))
    return wide(got).groupBy("x", "y", "value").agg(F.count(F.lit(1)).alias("n"))


def csv_xy_text(spark: Q, d: str) -> DataFrame:
    """Lines of two and of three fields."""
    both = _tagged(spark, d)
    got = readers.read_xy_text(spark, _csv(both.filter("id % 2 = 0"), "x", "y", "tag")).unionByName(readers.read_xy_text(spark, _csv(both.filter("id % 2 = 1"), "x", "y")))
    return wide(got).groupBy("x", "y", "value").agg(F.count(F.lit(1)).alias("n"))


def csv_to_wkt_points(spark: Q, d: str) -> DataFrame:
    at = scratch(spark)
    readers.csv_to_wkt(spark, _csv(_tagged(spark, d), "y", "x", "tag"), at)
    return wide(readers.read_wkt_query_points(spark, at)).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def sampled_rewrite(spark: Q, d: str) -> DataFrame:
    """Fields put in reverse order in a sample that takes every line."""
    source, at = scratch(spark), scratch(spark)
    points(spark, d).select(F.concat_ws(" ", F.col("y").cast("string"), F.col("x").cast("string"), F.col("id").cast("string")).alias("value")).write.text(source)
    readers.sample_and_rewrite(spark, source, at, 1.0, 4)
    f = spark.read.text(at).select(F.split("value", ",").alias("f"))
    return f.select(F.get("f", F.lit(0)).cast("long").alias("id"), *(F.get("f", F.lit(i)).cast("float").cast("double").alias(c) for i, c in ((1, "x"), (2, "y"))))


def rows_in_memory(spark: Q, d: str) -> DataFrame:
    return wide(readers.from_rows(spark, [(1.5, -2.25, "a"), (0.0, 90.0, ""), (180.0, 0.125, "b")]))


def generated_points(spark: Q, d: str) -> DataFrame:
    """How many uniform places are made, and whether all are whole-numbered and inside."""
    p = generators.uniform_points(spark, 50_000, 3000, 1000, x0=-100.0)
    return p.agg(F.count_distinct("id").alias("n"), F.min((F.floor("x") == F.col("x")) & F.col("x").between(-100, 2899) & F.col("y").between(0, 999)).alias("inside"))


def generated_gaussian(spark: Q, d: str) -> DataFrame:
    """How many normal places are made, and whether their moments are near those asked for."""
    p, c = generators.gaussian_points(spark, 200_000, (5.0, -7.0)), lambda v, a, e: F.abs(v - a) < e
    return p.agg(F.count_distinct("id").alias("n"), (c(F.avg("x"), 5.0, 1.0) & c(F.avg("y"), -7.0, 1.5)).alias("centred"), (c(F.var_samp("x"), 1000.0, 30.0) & c(F.var_samp("y"), 3000.0, 90.0) & c(F.covar_samp("x", "y"), 1.5, 30.0)).alias("spread"))


def generated_boxes(spark: Q, d: str) -> DataFrame:
    b = generators.random_boxes(spark, 20_000, 100.0, 50.0, 4.0)
    return b.agg(F.count_distinct("bid").alias("n"), F.min(F.col("x1").between(0, 100) & F.col("y1").between(0, 50) & (F.col("x2") - F.col("x1")).between(0, 4.001) & (F.col("y2") - F.col("y1")).between(0, 4.001)).alias("inside"))


def range_pruned(spark: Q, d: str) -> DataFrame:
    """Range search over the table as laid out by the quadtree: only folders that the box touches are read."""
    at, p = scratch(spark), points(spark, d).select("id", "x", "y", "tag")
    partitioning.write_layout(p, partitioning.quadtree_for(p, 32), 32, at)
    return xy(partitioning.read_layout(spark, at, BOX).filter(F.col("tag").isNotNull()), "tag")


def build_partitions(spark: Q, d: str) -> DataFrame:
    """The store spread over 12 partitions by key: its rows, keys and partitions."""
    s = store.build(points(spark, d).select("x", "y", "id"), "id", partitions=12).withColumn("pid", F.spark_partition_id())
    apart = s.groupBy("x", "y").agg(F.count_distinct("pid").alias("parts"))
    return s.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("pid").alias("partitions")).crossJoin(apart.agg(F.max("parts").alias("parts_of_a_key")))


def build_by_partitioner(spark: Q, d: str) -> DataFrame:
    """The places spread by a partition column of one's own: all rows, and each value of it in one partition."""
    p = store.build_with_partitioner(grids.Grid(10.0).place(points(spark, d)), F.col("cx"), 9).withColumn("pid", F.spark_partition_id())
    return p.groupBy("cx").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pid").alias("partitions"))


def physical_partitions(spark: Q, d: str) -> DataFrame:
    """Rows of the partitions as they lie, added up."""
    counts = grids.physical_partition_counts(points(spark, d).repartition(7, "id"))
    return counts.agg(F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("rows"))


def sampled_boxes(spark: Q, d: str) -> DataFrame:
    """The distinct boxes of the table."""
    return wide(boxes(spark, d).select("x1", "y1", "x2", "y2").distinct())


def insert_all(spark: Q, d: str) -> DataFrame:
    p = points(spark, d).select("x", "y", "id")
    return wide(store.insert_all(p, p.filter("id % 3 = 0"))).groupBy("x", "y", "id").agg(F.count(F.lit(1)).alias("n"))


def search_point(spark: Q, d: str) -> DataFrame:
    return xy(search.search_point(points(spark, d), 0.0, 0.0))


def geometry_hashes(spark: Q, d: str) -> DataFrame:
    """Equal rectangles have equal hashes and different ones different hashes."""
    b = boxes(spark, d).withColumn("h", G.geometry_hash(G.box()))
    return b.agg(F.count_distinct("h").alias("hashes"))


def corner_points(spark: Q, d: str) -> DataFrame:
    """A place as a box, and a box's upper-right corner."""
    p, c = G.to_box(G.point()), G.upper_right(G.box(F.col("x") - 1, F.col("y") - 1, F.col("x") + 1, F.col("y") + 1))
    return wide(points(spark, d).select("id", p.x2.alias("x2"), p.y1.alias("y1"), c.x.alias("right"), c.y.alias("top")))


def skew_cut(spark: Q, d: str) -> DataFrame:
    """The cells that the best cut divides cost less when divided than the heaviest that it leaves whole."""
    grid = grids.Grid(4.0)
    load = grids.cell_counts(points(spark, d), grid).join(grid.cover(boxes(spark, d)).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("visits")), ["cx", "cy"])
    cut = skew.optimal_cut(load)
    whole = load.join(cut.select("cx", "cy"), ["cx", "cy"], "left_anti").agg(F.max(F.col("n") * F.col("visits")).alias("whole"))
    return cut.crossJoin(whole).agg((F.count(F.lit(1)) > 0).alias("divided"), F.min(F.col("n") * F.col("visits") <= F.col("whole") * F.col("parts")).alias("lighter"), F.min(F.col("n") * F.col("visits") > F.col("whole")).alias("heaviest"))


def kmeans_settled(spark: Q, d: str) -> DataFrame:
    """Whether another step of k-means would leave the fitted centres where they are."""
    p = points(spark, d).select("x", "y")
    _, centres = kmeans.kmeans(p, 8)
    step = kmeans.lloyd_step(p, centres).select("cluster", F.col("x").alias("nx"), F.col("y").alias("ny"))
    old = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(centres)], "cluster long, ox double, oy double")
    return step.join(old, "cluster").agg(F.count(F.lit(1)).alias("clusters"), F.min((F.abs(F.col("nx") - F.col("ox")) < 0.05) & (F.abs(F.col("ny") - F.col("oy")) < 0.05)).alias("settled"))


def knn_approx_recall(spark: Q, d: str) -> DataFrame:
    """Whether the approximate join finds at least nine tenths of the exact pairs."""
    exact, quick = (f(points(spark, d), places(spark, d), 5).select("qid", "id") for f in (knn.knn_join, knn.knn_join_approx))
    counts = exact.join(quick.withColumn("hit", F.lit(1)), ["qid", "id"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.sum("hit").alias("hits"))
    return counts.select("pairs", (F.col("hits") >= 0.9 * F.col("pairs")).alias("found"))


NAMES = (
    "wkt_file_points", "wkt_file_queries", "wkt_file_boxes", "csv_lat_lon_text", "csv_xy_text", "csv_to_wkt_points", "sampled_rewrite", "rows_in_memory",
    "generated_points", "generated_gaussian", "generated_boxes", "range_pruned", "build_partitions", "build_by_partitioner", "physical_partitions", "sampled_boxes",
    "insert_all", "search_point", "geometry_hashes", "corner_points", "skew_cut", "knn_approx_recall", "kmeans_settled",
)
QUERIES = {n: globals()[n] for n in NAMES}

TAG = "coalesce(regexp_replace(tag, '[,\\r\\n]', ' ', 'g'), 'none')"
SQL = {
    "wkt_file_points": f"WITH {P} SELECT {XY}, '1' AS value, count(*) AS n FROM p GROUP BY p.x, p.y",
    "wkt_file_queries": f"WITH {S} SELECT CAST(qx AS DOUBLE) AS x, CAST(qy AS DOUBLE) AS y, count(*) AS n FROM q GROUP BY qx, qy",
    "wkt_file_boxes": f"WITH {B} SELECT CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, count(*) AS n FROM b GROUP BY b.x1, b.y1, b.x2, b.y2",
    "csv_lat_lon_text": f"WITH {P} SELECT {XY}, {TAG} AS value, count(*) AS n FROM p GROUP BY p.x, p.y, {TAG}",
    "csv_xy_text": f"WITH {P}, t AS (SELECT x, y, CASE WHEN id % 2 = 0 THEN {TAG} ELSE 'xxxx' END AS value FROM p) SELECT {XY}, value, count(*) AS n FROM t GROUP BY t.x, t.y, value",
    "csv_to_wkt_points": f"WITH {P} SELECT {XY}, count(*) AS n FROM p GROUP BY p.x, p.y",
    "sampled_rewrite": f"WITH {P} SELECT id, {XY} FROM p",
    "rows_in_memory": "SELECT * FROM (VALUES (CAST(1.5 AS DOUBLE), CAST(-2.25 AS DOUBLE), 'a'), (CAST(0 AS DOUBLE), CAST(90 AS DOUBLE), ''), (CAST(180 AS DOUBLE), CAST(0.125 AS DOUBLE), 'b')) AS t(x, y, value)",
    "generated_points": "SELECT CAST(50000 AS BIGINT) AS n, TRUE AS inside",
    "generated_gaussian": "SELECT CAST(200000 AS BIGINT) AS n, TRUE AS centred, TRUE AS spread",
    "generated_boxes": "SELECT CAST(20000 AS BIGINT) AS n, TRUE AS inside",
    "range_pruned": f"WITH {P} SELECT id, {XY}, tag FROM p WHERE {inside(BOX)} AND tag IS NOT NULL",
    "build_partitions": f"WITH {P} SELECT count(*) AS rows, CAST(12 AS BIGINT) AS partitions, CAST(1 AS BIGINT) AS parts_of_a_key FROM (SELECT DISTINCT x, y FROM p)",
    "build_by_partitioner": f"WITH {P} SELECT cx, count(*) AS n, CAST(1 AS BIGINT) AS partitions FROM (SELECT {cells(10.0)} FROM p) GROUP BY cx",
    "physical_partitions": f"WITH {P} SELECT CAST(7 AS BIGINT) AS partitions, count(*) AS rows FROM p",
    "sampled_boxes": f"WITH {B} SELECT DISTINCT CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM b",
    "insert_all": f"WITH {P} SELECT {XY}, id, 1 + CAST(id % 3 = 0 AS BIGINT) AS n FROM p",
    "search_point": f"WITH {P} SELECT id, {XY} FROM p WHERE p.x = 0 AND p.y = 0",
    "geometry_hashes": f"WITH {B} SELECT count(*) AS hashes FROM (SELECT DISTINCT x1, y1, x2, y2 FROM b)",
    "corner_points": f"WITH {P} SELECT id, CAST(x AS DOUBLE) AS x2, CAST(y AS DOUBLE) AS y1, CAST(x + CAST(1 AS FLOAT) AS DOUBLE) AS right, CAST(y + CAST(1 AS FLOAT) AS DOUBLE) AS top FROM p",
    "knn_approx_recall": f"WITH {S} SELECT count(*) * 5 AS pairs, TRUE AS found FROM q",
    "kmeans_settled": "SELECT CAST(8 AS BIGINT) AS clusters, TRUE AS settled",
    "skew_cut": "SELECT TRUE AS divided, TRUE AS lighter, TRUE AS heaviest",
}
