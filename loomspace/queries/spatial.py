"""Queries of the spatial operators, over whole tables.

Places are the records of ``points`` inside the world, each id once; boxes are the rows of ``boxes`` with finite corners, each id
once (inverted ones stay); query places are the ``stations`` inside the world, each id once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspace.functions import bits
from loomspace.functions import geometry as G
from loomspace.functions.hilbert import grid_position, hilbert_cell, hilbert_index, hilbert_ranges
from loomspace.functions.wkt import format_point, placed, with_geometry
from loomspace.operators import grid as grids
from loomspace.operators import joins, kmeans, knn, partitioning, search, sfilter, skew, store
from loomspace.operators.proximity import region_join
from loomspace.plans.runtime import table

Q = SparkSession
BOX = (-60.0, -30.0, 40.0, 35.5)
EDGE_BOX = (-93.5, -50.0, 62.75, 14.0)
PLACE = (28.25, 39.5)
K = 5


def points(spark: Q, d: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """All places, or those in a box: copies of an id share their place, so the box goes to the reader and only what it lets through is
    made unique."""
    rows = table(spark, d, "points").filter(placed(F.col("x"), F.col("y")))
    if box is not None:
        rows = search.range_filter(rows, box)
    return rows.groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("tag").alias("tag"), F.min("text").alias("text"))


def raw(spark: Q, d: str) -> DataFrame:
    """The places with their copies."""
    return table(spark, d, "points").filter(placed(F.col("x"), F.col("y"))).select("id", "x", "y", "tag")


def boxes(spark: Q, d: str) -> DataFrame:
    raw = table(spark, d, "boxes").select(F.col("box_id").alias("bid"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    return raw.filter(G.is_finite(G.box())).groupBy("bid").agg(*(F.min(c).alias(c) for c in joins.CORNERS))


def places(spark: Q, d: str) -> DataFrame:
    raw = table(spark, d, "stations").filter(placed(F.col("x"), F.col("y")))
    return raw.groupBy(F.col("station_id").alias("qid")).agg(F.min("x").alias("qx"), F.min("y").alias("qy"))


def wide(df: DataFrame) -> DataFrame:
    """Single-precision columns as double, for comparison across engines."""
    return df.select(*(F.col(c).cast("double").alias(c) if t == "float" else F.col(c) for c, t in df.dtypes))


def xy(df: DataFrame, *more: str) -> DataFrame:
    return wide(df.select("id", "x", "y", *more))


# range search -------------------------------------------------------------------------------------------------------


def range_filter(spark: Q, d: str) -> DataFrame:
    return xy(points(spark, d, BOX).filter(F.col("tag").isNotNull()), "tag")


def range_filter_boundary(spark: Q, d: str) -> DataFrame:
    return xy(points(spark, d, EDGE_BOX).select("id", "x", "y").unionByName(search.range_filter(hot_places(spark, d), EDGE_BOX)))


def hot_places(spark: Q, d: str) -> DataFrame:
    """Entries' places with ids of their own; many lie exactly on an edge of the box."""
    e = with_geometry(table(spark, d, "entries").select("entry_id", "geom"), "geom", points_only=True)
    return e.groupBy(F.col("entry_id").alias("id")).agg(F.min("geometry.x1").alias("x"), F.min("geometry.y1").alias("y"))


def range_count(spark: Q, d: str) -> DataFrame:
    return points(spark, d, BOX).agg(F.count(F.lit(1)).alias("n"))


def range_fold(spark: Q, d: str) -> DataFrame:
    return wide(search.fold_search(points(spark, d, BOX), BOX, *G.mbr(), F.count(F.lit(1)).alias("n")))


def range_intersects(spark: Q, d: str) -> DataFrame:
    return wide(search.search_intersecting(boxes(spark, d).filter("x1 <= x2 AND y1 <= y2"), BOX))


def spatial_text(spark: Q, d: str) -> DataFrame:
    return xy(search.text_search(points(spark, d, BOX), BOX, "text", ["apple", "google"], ["BAD"]), "text")


def contains_entries(spark: Q, d: str) -> DataFrame:
    p = points(spark, d)
    return wide(search.contains_entries(p.select("x", "y", "tag").distinct(), p.filter("tag = 'view'"), ["x", "y", "tag"]))


# nearest neighbours -------------------------------------------------------------------------------------------------


def knn_filter(spark: Q, d: str) -> DataFrame:
    return xy(search.knn_distinct(raw(spark, d), *PLACE, 10), "dist")


def knn_filter_pred(spark: Q, d: str) -> DataFrame:
    return xy(search.knn_distinct(raw(spark, d), *PLACE, 10, predicate=F.col("tag") == "view"), "dist")


def nearest(spark: Q, d: str) -> DataFrame:
    return xy(search.knn_distinct(raw(spark, d), *PLACE, 1), "dist")


def knn_join(spark: Q, d: str) -> DataFrame:
    return knn.knn_join(points(spark, d), places(spark, d), K)


def knn_join_pred(spark: Q, d: str) -> DataFrame:
    return knn.knn_join(points(spark, d), places(spark, d), K, F.col("x") > 0, F.col("tag") == "view")


def knn_join_hilbert(spark: Q, d: str) -> DataFrame:
    return knn.knn_join(points(spark, d), places(spark, d), K, strategy="hilbert")


def knn_join_pivots(spark: Q, d: str) -> DataFrame:
    return knn.knn_join(points(spark, d), places(spark, d), K, strategy="pivots")


def knn_join_collected(spark: Q, d: str) -> DataFrame:
    flat = knn.knn_join_collected(points(spark, d), places(spark, d), K)
    return flat.select("qid", F.array_join(F.transform("neighbours", lambda e: e["id"].cast("string")), ",").alias("ids"))


def knn_join_approx(spark: Q, d: str) -> DataFrame:
    return knn.knn_join_approx(points(spark, d), places(spark, d), K)


# joins --------------------------------------------------------------------------------------------------------------


def sjoin(spark: Q, d: str) -> DataFrame:
    return xy(joins.sjoin(points(spark, d), boxes(spark, d)))


def sjoin_map(spark: Q, d: str) -> DataFrame:
    return xy(joins.sjoin(points(spark, d), boxes(spark, d), shout=F.upper("tag")), "shout")


def sjoin_scheduled(spark: Q, d: str) -> DataFrame:
    return xy(skew.scheduled_sjoin(points(spark, d), boxes(spark, d)))


def _counted() -> dict:
    return {"n": F.count(F.lit(1)), "ids": F.sum("id"), "mean_x": F.round(F.avg(F.col("x").cast("double")), 6)}


def rjoin_count(spark: Q, d: str) -> DataFrame:
    return joins.rjoin(points(spark, d), boxes(spark, d), "bid", {"n": F.count(F.lit(1))}, {"n": F.lit(0)})


def rjoin_sum(spark: Q, d: str) -> DataFrame:
    return joins.rjoin(points(spark, d), boxes(spark, d), "bid", _counted(), {"n": F.lit(0), "ids": F.lit(0)})


def rjoin_inner(spark: Q, d: str) -> DataFrame:
    return joins.rjoin(points(spark, d), boxes(spark, d), "bid", _counted(), how="inner")


def rjoin_pairs(spark: Q, d: str) -> DataFrame:
    return joins.rjoin_pairs(points(spark, d).select("id", "x", "y"), boxes(spark, d)).select("bid", "id")


def rjoin_prepared(spark: Q, d: str) -> DataFrame:
    p, b = points(spark, d).select("id", "x", "y"), boxes(spark, d)
    return joins.prepared_pairs(joins.prepare_places(p, b, 16), joins.prepare_boxes(b, 16)).select("bid", "id")


def _both(spark: Q, d: str) -> tuple[DataFrame, DataFrame]:
    p, b = points(spark, d).select("id", "x", "y"), boxes(spark, d)
    return joins.prepare_places(p, b, 16), joins.prepare_boxes(b, 16)


def sjoin_prepared(spark: Q, d: str) -> DataFrame:
    return xy(joins.prepared_sjoin(*_both(spark, d)))


def rjoin_prepared_count(spark: Q, d: str) -> DataFrame:
    return joins.prepared_rjoin(*_both(spark, d), boxes(spark, d), "bid", {"n": F.count(F.lit(1)), "ids": F.sum("id")}, {"n": F.lit(0), "ids": F.lit(0)})


def rjoin_custom(spark: Q, d: str) -> DataFrame:
    """The largest id of each box's places, as an aggregate of one's own."""
    return joins.rjoin_custom(points(spark, d).select("id", "x", "y"), boxes(spark, d), "bid", lambda rows: int(rows["id"].max()), max, "bigint", 0).withColumnRenamed("value", "last")


def rjoin_quadtree(spark: Q, d: str) -> DataFrame:
    p = points(spark, d).select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return region_join(boxes(spark, d).withColumnRenamed("bid", "id"), p, "contains").select(F.col("left_id").alias("bid"), F.col("right_id").alias("id"))


def box_intersections(spark: Q, d: str) -> DataFrame:
    b = boxes(spark, d).withColumnRenamed("bid", "id")
    e = with_geometry(table(spark, d, "entries").select("entry_id", "geom"), "geom").select(F.col("entry_id").alias("id"), "geometry.x1", "geometry.y1", "geometry.x2", "geometry.y2")
    return region_join(b, e, "intersects").select(F.col("left_id").alias("bid"), F.col("right_id").alias("entry_id"))


def rjoin_scheduled(spark: Q, d: str) -> DataFrame:
    return skew.scheduled_rjoin(points(spark, d), boxes(spark, d), "bid", {"n": F.count(F.lit(1)), "ids": F.sum("id")}, {"n": F.lit(0), "ids": F.lit(0)})


# scalar geometry ----------------------------------------------------------------------------------------------------


def geom_scalars(spark: Q, d: str) -> DataFrame:
    b = G.box()
    return wide(boxes(spark, d).select("bid", G.width(b).alias("w"), G.height(b).alias("h"), G.area(b).alias("a"), *(c.alias(f"n_{n}") for n, c in G.normalize(b)._asdict().items())))


def geom_predicates(spark: Q, d: str) -> DataFrame:
    a, b, p = G.box(), G.box(*BOX), G.point(*PLACE)
    return boxes(spark, d).select(
        "bid", G.contains(b, a).alias("inside"), G.intersects(a, b).alias("meets"), G.wraps(b, a).alias("wrapped"), G.equals(a, b).alias("same"),
        G.contains(a, p).alias("holds"), G.wraps(a, p).alias("holds_open"), G.less(G.lower_left(a), p).alias("below"),
    )


def box_box_ops(spark: Q, d: str) -> DataFrame:
    a, b = G.box(), G.box(*BOX)
    i, e = G.intersect_box(a, b), G.expand(a, b)
    return wide(boxes(spark, d).select(
        "bid", G.intersection_area(a, b).alias("shared"), G.expand_area(a, b).alias("growth"), G.edge_gap(a, b).alias("gap"), G.box_distance(a, b).alias("dist"),
        i.x1.alias("ix1"), i.y2.alias("iy2"), e.x1.alias("ex1"), e.y2.alias("ey2"), G.area_ratio(a, b).alias("ratio"),
    ))


def box_point_distance(spark: Q, d: str) -> DataFrame:
    a, p = G.box(), G.point(*PLACE)
    return boxes(spark, d).filter("x1 <= x2 AND y1 <= y2").select("bid", G.distance_squared(a, p).alias("d2"), G.distance(a, p).alias("dist"), G.distance(G.lower_left(a), p).alias("corner"))


def mbr_agg(spark: Q, d: str) -> DataFrame:
    return wide(points(spark, d).groupBy("tag").agg(*G.mbr(), F.count(F.lit(1)).alias("n")))


# store --------------------------------------------------------------------------------------------------------------


def _store(spark: Q, d: str) -> DataFrame:
    """One record for each place: the least id."""
    return store.build(points(spark, d).select("x", "y", "id"), "id")


def _new(spark: Q, d: str) -> DataFrame:
    """Changes: every third place of the store gets a new value, every station becomes a place."""
    old = _store(spark, d).filter("id % 3 = 0").select("x", "y", (-F.col("id")).alias("id"))
    added = places(spark, d).groupBy("qx", "qy").agg(F.min("qid").alias("id")).select(F.col("qx").alias("x"), F.col("qy").alias("y"), "id")
    return store.build(old.unionByName(added), "id")


def build_dedup(spark: Q, d: str) -> DataFrame:
    return wide(_store(spark, d))


def put_overwrite(spark: Q, d: str) -> DataFrame:
    return wide(store.put(_store(spark, d), _new(spark, d)))


def multiput_sum(spark: Q, d: str) -> DataFrame:
    return wide(store.multiput(_store(spark, d), _new(spark, d), merge=lambda name, old, new: old + new))


def multiput_general(spark: Q, d: str) -> DataFrame:
    return wide(store.multiput(_store(spark, d), _new(spark, d), merge=lambda name, old, new: F.greatest(old, new), fresh=lambda name, new: new * 10))


def insert_merged(spark: Q, d: str) -> DataFrame:
    return wide(store.insert_merged(points(spark, d), records=F.count(F.lit(1)), last=F.max("id")))


def point_lookup(spark: Q, d: str) -> DataFrame:
    return wide(store.get(points(spark, d), x=0.0, y=0.0)).select("id", "x", "y")


def multiget(spark: Q, d: str) -> DataFrame:
    """Every fifth place, and the stations, none of which is a place."""
    wanted = points(spark, d).filter("id % 5 = 0").select("x", "y").unionByName(places(spark, d).select(F.col("qx").alias("x"), F.col("qy").alias("y")))
    return xy(store.multiget(points(spark, d), wanted))


def delete_keys(spark: Q, d: str) -> DataFrame:
    return wide(store.delete(_store(spark, d), _new(spark, d)))


def remove_entries(spark: Q, d: str) -> DataFrame:
    s = _store(spark, d)
    return wide(store.remove_all(s, s.filter("id % 2 = 0")))


def store_differences(spark: Q, d: str) -> DataFrame:
    s = _store(spark, d)
    return wide(store.differences(s, store.put(s, _new(spark, d))))


def map_values(spark: Q, d: str) -> DataFrame:
    return store.values(store.map_values(_store(spark, d), id=F.col("id") % 1000)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


# partitioning, skew, filter, curve, k-means -------------------------------------------------------------------------

GRID = grids.Grid(4.0)


def grid_partition_counts(spark: Q, d: str) -> DataFrame:
    return grids.partition_counts(points(spark, d), GRID, 500)


def grid_cell_counts(spark: Q, d: str) -> DataFrame:
    return grids.cell_counts(points(spark, d), GRID)


def box_cells(spark: Q, d: str) -> DataFrame:
    return GRID.cover(boxes(spark, d)).select("bid", "cx", "cy")


def quadtree_leaf_counts(spark: Q, d: str) -> DataFrame:
    """The places of the leaves, none of them outside its leaf, and no leaf too full."""
    p = points(spark, d)
    rows = p.count()
    return partitioning.leaf_audit(p, partitioning.quadtree_for(p, 16, rows), max(1, rows // 16))


def _balance(counts: DataFrame) -> DataFrame:
    """Partitions, places, and whether every number of a partition is one of the 16."""
    return counts.agg(F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("places"), F.min(F.col("pid").between(0, 15)).alias("numbered"))


def quadtree_partition_counts(spark: Q, d: str) -> DataFrame:
    p = points(spark, d)
    tree = partitioning.quadtree_for(p, 16)
    pids = F.broadcast(partitioning.partition_of_leaves(spark, partitioning.pack_leaves(tree.weight, 16)))
    return _balance(partitioning.leaf_counts(p, tree).join(pids, "leaf").groupBy("pid").agg(F.sum("n").alias("n")))


def quadtree_load_partitions(spark: Q, d: str) -> DataFrame:
    p = points(spark, d)
    tree = partitioning.quadtree_for(p, 16)
    visits = partitioning.query_visits(boxes(spark, d), tree)
    load = partitioning.leaf_counts(p, tree).join(visits, "leaf", "full_outer").select("leaf", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("visits", F.lit(0)).alias("visits")).toPandas()
    counts = load.set_index("leaf").reindex(range(len(tree)), fill_value=0)
    pids = partitioning.partition_of_leaves(spark, partitioning.pack_by_load(counts["n"].to_numpy(), counts["visits"].to_numpy(), 16))
    return _balance(partitioning.leaf_counts(p, tree).join(F.broadcast(pids), "leaf").groupBy("pid").agg(F.sum("n").alias("n")))


def skew_report(spark: Q, d: str) -> DataFrame:
    return skew.skew_report(grids.cell_counts(points(spark, d), GRID))


def top_cells(spark: Q, d: str) -> DataFrame:
    return skew.top_groups(grids.cell_counts(points(spark, d), GRID), 10)


FINE = grids.Grid(1.0)


def _filter(spark: Q, d: str) -> DataFrame:
    return sfilter.train(points(spark, d), FINE)


def sfilter_may_contain(spark: Q, d: str) -> DataFrame:
    return sfilter.may_contain(boxes(spark, d), _filter(spark, d), FINE, "bid").select("bid")


def sfilter_empty_fraction(spark: Q, d: str) -> DataFrame:
    return sfilter.empty_fraction(boxes(spark, d), _filter(spark, d), FINE, "bid").select("bid", F.round("fraction", 6).alias("fraction"))


def sfilter_mark_empty(spark: Q, d: str) -> DataFrame:
    return sfilter.mark_empty(_filter(spark, d), FINE, BOX)


def sfilter_coarse(spark: Q, d: str) -> DataFrame:
    return sfilter.coarsen(_filter(spark, d), 4)


def sfilter_encoded_count(spark: Q, d: str) -> DataFrame:
    return sfilter.encoded_count(sfilter.encode(_filter(spark, d), FINE))


def sfilter_encoded_probe(spark: Q, d: str) -> DataFrame:
    return sfilter.may_contain_encoded(boxes(spark, d), sfilter.encode(_filter(spark, d), FINE), FINE, "bid").select("bid")


def sfilter_decoded(spark: Q, d: str) -> DataFrame:
    return sfilter.decode(sfilter.encode(_filter(spark, d), FINE), FINE)


def sfilter_mostly_empty(spark: Q, d: str) -> DataFrame:
    return sfilter.mostly_empty(boxes(spark, d), _filter(spark, d), FINE, "bid", 0.5).select("bid")


ORDER = 10


def hilbert_roundtrip(spark: Q, d: str) -> DataFrame:
    cells = points(spark, d).select(grid_position(F.col("x"), -180.0, 180.0, ORDER).alias("cx"), grid_position(F.col("y"), -90.0, 90.0, ORDER).alias("cy")).distinct()
    back = hilbert_cell(hilbert_index(F.col("cx"), F.col("cy"), ORDER), ORDER)
    return cells.withColumn("b", back).select(F.col("b.cx").cast("long").alias("cx"), F.col("b.cy").cast("long").alias("cy"))


def hilbert_order(spark: Q, d: str) -> DataFrame:
    cells = points(spark, d).select("id", hilbert_index(grid_position(F.col("x"), -180.0, 180.0, 4), grid_position(F.col("y"), -90.0, 90.0, 4), 4).alias("h"))
    return cells.groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def hilbert_ranges_scan(spark: Q, d: str) -> DataFrame:
    """Places in a rectangle of curve cells (columns 20 to 41, rows 17 to 30 of 64), found by index ranges."""
    h = hilbert_index(grid_position(F.col("x"), -180.0, 180.0, 6), grid_position(F.col("y"), -90.0, 90.0, 6), 6)
    return xy(search.hilbert_filter(points(spark, d).withColumn("h", h), "h", hilbert_ranges(20, 17, 41, 30, 6)))


CENTRES = [(-100.0, 40.0), (0.0, 0.0), (60.5, -30.0), (120.0, 50.0)]


def kmeans_step(spark: Q, d: str) -> DataFrame:
    step = kmeans.lloyd_step(points(spark, d), CENTRES)
    return step.select("cluster", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("d2", 1).alias("d2"))


def kmeans_fit(spark: Q, d: str) -> DataFrame:
    dispersion, centres = kmeans.kmeans(points(spark, d), 8, restarts=25, tolerance=1e-4, most=100)
    return spark.createDataFrame([(i, a, b, dispersion) for i, (a, b) in enumerate(centres)], "cluster int, x double, y double, dispersion double")


def wkt_roundtrip(spark: Q, d: str) -> DataFrame:
    written = points(spark, d).select("id", format_point(F.col("x"), F.col("y")).alias("line"))
    return wide(with_geometry(written, "line").select("id", F.col("geometry.x1").alias("x"), F.col("geometry.y1").alias("y")))


def wkt_scan(spark: Q, d: str) -> DataFrame:
    g = with_geometry(table(spark, d, "entries").select("entry_id", "geom"), "geom").select("entry_id", *(F.col(f"geometry.{c}") for c in joins.CORNERS))
    return wide(g.groupBy("entry_id").agg(*(F.min(c).alias(c) for c in joins.CORNERS)))


def bit_ops(spark: Q, d: str) -> DataFrame:
    i = F.col("id")
    return points(spark, d).select(
        "id", bits.set_bit(i, 3).alias("set3"), bits.clear_bit(i, 4).alias("clear4"), bits.get_bit(i, 5).alias("bit5"), bits.get_bits(i, 4, 8).alias("byte"),
        bits.count_bits(i).cast("int").alias("ones"), bits.count_bits_below(i, 12).cast("int").alias("low_ones"), bits.bit_string(i).alias("text"),
    )


NAMES = (
    "range_filter", "range_filter_boundary", "range_count", "range_fold", "range_intersects", "spatial_text", "contains_entries",
    "knn_filter", "knn_filter_pred", "nearest", "knn_join", "knn_join_pred", "knn_join_hilbert", "knn_join_pivots", "knn_join_collected", "knn_join_approx",
    "sjoin", "sjoin_map", "sjoin_scheduled", "rjoin_count", "rjoin_sum", "rjoin_inner", "rjoin_pairs", "rjoin_prepared", "sjoin_prepared", "rjoin_prepared_count", "rjoin_custom", "rjoin_quadtree", "rjoin_scheduled", "box_intersections",
    "geom_scalars", "geom_predicates", "box_box_ops", "box_point_distance", "mbr_agg",
    "build_dedup", "put_overwrite", "multiput_sum", "multiput_general", "insert_merged", "point_lookup", "multiget", "delete_keys", "remove_entries", "store_differences", "map_values",
    "grid_partition_counts", "grid_cell_counts", "box_cells", "quadtree_leaf_counts", "quadtree_partition_counts", "quadtree_load_partitions", "skew_report", "top_cells",
    "sfilter_may_contain", "sfilter_empty_fraction", "sfilter_mark_empty", "sfilter_coarse", "sfilter_encoded_count", "sfilter_encoded_probe", "sfilter_decoded", "sfilter_mostly_empty",
    "hilbert_roundtrip", "hilbert_order", "hilbert_ranges_scan", "kmeans_step", "kmeans_fit", "wkt_roundtrip", "wkt_scan", "bit_ops",
)
QUERIES = {n: globals()[n] for n in NAMES}
