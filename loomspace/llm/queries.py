"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspace.functions.wkt import placed, with_geometry
from loomspace.llm.leakage import find_leaks, remove_leaks
from loomspace.llm.packing import byte_tokens, pack
from loomspace.llm.pii import find_personal, redact
from loomspace.llm.rpforest import nearest_vectors
from loomspace.llm.spectral import CellGrid, anchored_groups, fold_cells, spectral_clusters, spectral_labels
from loomspace.llm.topn import top_n_per_group
from loomspace.plans.runtime import table

CAPACITY = 4096


def _placed_points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "points").filter(placed(F.col("x"), F.col("y"))).select("id", "x", "y")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five records of points nearest to each query place."""
    places = with_geometry(table(spark, folder, "query_points").select("qid", "geom"), "geom", points_only=True)
    places = places.select("qid", F.col("geometry.x1").alias("x"), F.col("geometry.y1").alias("y"))
    rows = table(spark, folder, "points").count()
    return nearest_vectors(places, _placed_points(spark, folder), "qid", "id", ["x", "y"], 5, rows=rows).select("qid", "id")


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The three other records most similar to each record whose id is divisible by 20, out of all records."""
    rows = _placed_points(spark, folder)
    near = nearest_vectors(rows.filter("id % 20 = 0").withColumnRenamed("id", "qid"), rows, "qid", "id", ["x", "y"], 4)
    return near.filter("qid <> id").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter("rank <= 3").select("qid", "id", "rank")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three entries of highest value at each location."""
    found = with_geometry(table(spark, folder, "entries").select("entry_id", "geom", "value").filter("value IS NOT NULL AND NOT isnan(value)"), "geom")
    places = found.select("entry_id", "value", "geometry.x1", "geometry.y1", "geometry.x2", "geometry.y2")
    return top_n_per_group(places, ["x1", "y1", "x2", "y2"], "value", "entry_id", 3, agreeing=True).select("entry_id")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), "doc_id", byte_tokens(F.col("text")), CAPACITY)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that had to be split."""
    return _packed(spark, folder).filter("pieces > 1 AND piece = 0").select("doc_id")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece with its container and place."""
    return _packed(spark, folder)


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What any packing must keep: documents and tokens all there, containers no fuller than the capacity, pieces of a container side by
    side, and containers at least 98 % full but for the 64 that each input partition leaves open."""
    pieces = _packed(spark, folder).withColumn("part", F.shiftright("container", 33)).withColumn("before", F.coalesce(F.sum("tokens").over(Window.partitionBy("container").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = pieces.groupBy("part", "container").agg(F.sum("tokens").alias("filled"), F.sum((F.col("before") != F.col("start")).cast("int")).alias("apart"))
    parts = each.groupBy("part").agg(F.sum("filled").alias("tokens"), F.count(F.lit(1)).alias("containers"), F.max("filled").alias("most"), F.sum("apart").alias("apart"))
    total = parts.agg(F.sum("tokens").alias("tokens"), F.max("most").alias("most"), F.sum("apart").alias("apart"), F.sum(F.greatest(F.col("containers") - 64, F.lit(0))).alias("closed"))
    documents = pieces.agg(F.count_distinct("doc_id").alias("documents"))
    return total.crossJoin(documents).select("documents", "tokens", (F.col("most") <= CAPACITY).alias("within"), (F.col("apart") == 0).alias("side_by_side"), (F.col("tokens") >= 0.98 * CAPACITY * F.col("closed")).alias("full"))


REACH = 0.85


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records of each anchor's group."""
    return anchored_groups(table(spark, folder, "points"), table(spark, folder, "anchors"), REACH)


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """All clusters of records with their size and most typical records."""
    return spectral_clusters(table(spark, folder, "points"), REACH)


def p1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How well the spectral clusters meet the groups of ``p1_found`` before any linkage trims them: of each anchor's group the size, whether
    one cluster holds 95 % of it, and whether it makes up 95 % of that cluster."""
    grid = CellGrid(REACH)
    rows = _placed_points(spark, folder).dropDuplicates(["id"])
    labels = spectral_labels(fold_cells(rows, grid), rows, grid).select("cx", "cy", "n", "cluster")
    cells = anchored_groups(rows, table(spark, folder, "anchors"), REACH).join(rows.select("id", *grid.columns()), "id").groupBy("anchor_id", "cx", "cy").agg(F.count(F.lit(1)).alias("own"))
    shared = cells.join(labels, ["cx", "cy"]).groupBy("anchor_id", "cluster").agg(F.sum("own").alias("own"))
    best = shared.groupBy("anchor_id").agg(F.sum("own").alias("records"), F.max(F.struct("own", "cluster")).alias("best"))
    sizes = labels.groupBy("cluster").agg(F.sum("n").alias("size"))
    both = best.join(sizes, F.col("best.cluster") == F.col("cluster"))
    return both.select("anchor_id", "records", (F.col("best.own") >= 0.95 * F.col("records")).alias("whole"), (F.col("best.own") >= 0.95 * F.col("size")).alias("pure"))


def p7_left(spark: SparkSession, folder: str) -> DataFrame:
    """How many leaks are left in the cleaned documents."""
    return find_leaks(p7_cleaned(spark, folder), table(spark, folder, "eval_items")).agg(F.count(F.lit(1)).alias("leaks"))


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the queue search alone, without the exact check after it, finds at least nine tenths of the nearest records."""
    rows = _placed_points(spark, folder)
    asked = rows.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    exact, quick = (nearest_vectors(asked, rows, "qid", "id", ["x", "y"], 5, exact=e).select("qid", "id") for e in (True, False))
    counts = exact.join(quick.withColumn("hit", F.lit(1)), ["qid", "id"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.sum("hit").alias("hits"))
    return counts.select("pairs", (F.col("hits") >= 0.9 * F.col("pairs")).alias("found"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry passages of evaluation items."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("item_id", "doc_id").distinct()


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without leaked passages."""
    return remove_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct personal value of each document."""
    return find_personal(table(spark, folder, "documents"), table(spark, folder, "given_names")).select("doc_id", "kind", "value").distinct()


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with placeholders in place of personal values."""
    return redact(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "given_names"))
