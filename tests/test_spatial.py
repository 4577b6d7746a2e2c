"""The spatial operators against brute force, and two plans against each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.functions import bits
from loomspace.functions import geometry as G
from loomspace.functions.hilbert import hilbert_cell, hilbert_index, hilbert_ranges
from loomspace.operators import grid as grids
from loomspace.operators import joins, kmeans, knn, partitioning, search, sfilter, skew, store
from loomspace.plans.inspect import nested_loops, pushed_filters, read_columns, shuffles

NAN, INF = math.nan, math.inf


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    rows = [(i, float(x), float(y), "abc"[i % 3]) for i, (x, y) in enumerate(np.round(rng.uniform(-50, 50, (800, 2)) * 4) / 4)]
    rows += [(1000 + i, 7.5, 7.5, "a") for i in range(300)]
    rows += [(5000, NAN, 1.0, "a"), (5001, None, 1.0, "b"), (5002, INF, 0.0, "a"), (5003, 10.0, 10.0, None)]
    df = spark.createDataFrame(rows, "id long, x float, y float, tag string").withColumn("part", F.lit("x")).persist()
    df.rows = rows
    return df


@pytest.fixture(scope="module")
def boxes(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 10.0, 5.0, 5.0), (3, 7.5, 7.5, 7.5, 7.5), (4, -1000.0, -1000.0, 1000.0, 1000.0), (5, 60.0, 60.0, 70.0, 70.0), (6, NAN, 0.0, 1.0, 1.0), (7, -20.0, -3.0, 20.0, -2.5), (8, -INF, 0.0, INF, 1.0), (9, None, 0.0, 1.0, 1.0)]
    rows += [(100 + i, float(i % 40 - 20), float(i % 30 - 15), float(i % 40 - 20 + i % 5), float(i % 30 - 15 + i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "bid long, x1 float, y1 float, x2 float, y2 float").persist()
    df.rows = rows
    return df


def _pairs(points, boxes):
    good = [b for b in boxes.rows if all(v is not None and math.isfinite(v) for v in b[1:])]
    return {(b[0], p[0]) for b in good for p in points.rows if p[1] is not None and b[1] <= p[1] <= b[3] and b[2] <= p[2] <= b[4]}


def test_joins_equal_nested_loop(spark, points, boxes):
    want = _pairs(points, boxes)
    got = [tuple(r) for r in joins.rjoin_pairs(points, boxes).select("bid", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["id"] for r in joins.sjoin(points, boxes).collect()} == {i for _, i in want}
    counts = {b: sum(x == b for x, _ in want) for b, *_ in boxes.rows}
    left = joins.rjoin(points, boxes, "bid", {"n": F.count(F.lit(1)), "most": F.max("id")}, {"n": F.lit(0)})
    assert {r["bid"]: r["n"] for r in left.collect()} == counts
    assert left.filter("bid = 5").first()["most"] is None
    inner = joins.rjoin(points, boxes, "bid", {"n": F.count(F.lit(1))}, how="inner")
    assert {r["bid"]: r["n"] for r in inner.collect()} == {b: n for b, n in counts.items() if n}
    mapped = joins.sjoin(points, boxes, tag=F.upper("tag")).filter("tag IS NOT NULL")
    assert {r["tag"] for r in mapped.collect()} == {"A", "B", "C"}


def test_skew_joins_equal_plain_joins(points, boxes):
    hot = skew.hot_cells(points, boxes)
    assert hot.count() > 0
    plain, salted = joins.rjoin(points, boxes, "bid", {"n": F.count(F.lit(1))}, {"n": F.lit(0)}), skew.scheduled_rjoin(points, boxes, "bid", {"n": F.count(F.lit(1))}, {"n": F.lit(0)})
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0
    a, b = joins.sjoin(points, boxes).select("id"), skew.scheduled_sjoin(points, boxes).select("id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    report = skew.skew_report(grids.cell_counts(points.filter("x < 100"), grids.Grid(4.0))).first()
    assert report["largest"] >= 300 and report["rows"] == 1101 and report["hot"] >= 1
    assert skew.top_groups(grids.cell_counts(points.filter("x < 100"), grids.Grid(4.0)), 1).first()["n"] == report["largest"]


def test_empty_sides(points, boxes):
    assert joins.rjoin_pairs(points.limit(0), boxes).count() == 0
    assert joins.rjoin_pairs(points, boxes.limit(0)).count() == 0
    assert joins.rjoin(points.limit(0), boxes, "bid", {"n": F.count(F.lit(1))}, {"n": F.lit(0)}).filter("n = 0").count() == len(boxes.rows)
    assert joins.sjoin(points, boxes.limit(0)).count() == 0


def test_joins_are_no_nested_loops(points, boxes):
    for df in (joins.rjoin_pairs(points, boxes), joins.sjoin(points, boxes)):
        assert nested_loops(df) == 0


def test_prepared_sides_are_not_shuffled_again(points, boxes):
    p, b = joins.prepare_places(points, boxes, 6), joins.prepare_boxes(boxes, 6)
    pairs = joins.prepared_pairs(p, b)
    assert shuffles(pairs) == 2  # the two preparations
    assert {tuple(r) for r in pairs.select("bid", "id").collect()} == _pairs(points, boxes)


def test_custom_aggregate(points, boxes):
    got = joins.rjoin_custom(points.select("id", "x", "y"), boxes, "bid", lambda rows: len(rows), lambda a, b: a + b, "bigint", 0)
    want = _pairs(points, boxes)
    assert {r["bid"]: r["value"] for r in got.collect()} == {b: sum(x == b for x, _ in want) for b, *_ in boxes.rows}


def _knn(points, queries, k, ok=lambda p: True):
    out = {}
    good = sorted({(p[0], np.float32(p[1]), np.float32(p[2])) for p in points.rows if p[1] is not None and math.isfinite(p[1]) and ok(p)})
    for q, x, y in set(queries):
        if x is None or not math.isfinite(x):
            continue
        near = sorted((math.sqrt(float(px - np.float32(x)) ** 2 + float(py - np.float32(y)) ** 2), i) for i, px, py in good)
        out[q] = [i for _, i in near[:k]]
    return out


@pytest.mark.parametrize("strategy", ["each", "hilbert", "pivots"])
def test_knn_join_is_exact(spark, points, strategy):
    queries = [(i, float(i * 7 % 100 - 50), float(i * 13 % 100 - 50)) for i in range(40)] + [(100, 7.5, 7.5), (101, 7.5, 7.5), (101, 7.5, 7.5), (102, 170.0, -89.0), (103, None, 1.0), (104, NAN, 0.0)]
    q = spark.createDataFrame(queries, "qid long, qx float, qy float").withColumn("id", F.lit("x")).withColumn("part", F.lit(0))
    got = {}
    for r in knn.knn_join(points, q, 6, strategy=strategy, target=60, run=5).orderBy("qid", "rk").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == _knn(points, queries, 6)
    some = {}
    for r in knn.knn_join(points, q, 3, F.col("x") > 0, F.col("tag") == "b", strategy=strategy, target=60).orderBy("qid", "rk").collect():
        some.setdefault(r["qid"], []).append(r["id"])
    assert some == _knn(points, queries, 3, lambda p: p[1] > 0 and p[3] == "b")


def test_knn_join_edges(spark, points):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "qid long, qx float, qy float")
    few = points.filter("id < 3")
    assert knn.knn_join(few, q, 10).count() == 6
    assert knn.knn_join(points, q, 0).count() == 0 and knn.knn_join(points.limit(0), q, 3).count() == 0 and knn.knn_join(points, q.limit(0), 3).count() == 0
    nested = {r["qid"]: [e["id"] for e in r["neighbours"]] for r in knn.knn_join_collected(points, q, 4).collect()}
    assert nested == _knn(points, [(1, 0.0, 0.0), (2, 9.0, 9.0)], 4)
    exact, near = knn.knn_join(points, q, 4), knn.knn_join_approx(points, q, 4)
    assert near.join(exact, ["qid", "rk"]).filter(near["dist"] < exact["dist"]).count() == 0
    with pytest.raises(ValueError):
        knn.knn_join(points, q, 3, strategy="guess")


def test_search(spark, points):
    ids = lambda df: {r["id"] for r in df.collect()}
    inside = {p[0] for p in points.rows if p[1] is not None and 0 <= p[1] <= 10 and 0 <= p[2] <= 10}
    assert ids(search.range_filter(points, (0, 0, 10, 10))) == inside and 5003 in inside
    assert ids(search.range_filter(points, (10, 10, 0, 0))) == set() and ids(search.range_filter(points, (NAN, 0, 1, 1))) == set()
    assert search.range_filter(points, (7.5, 7.5, 7.5, 7.5), distinct_key=True).count() == 1
    assert search.range_count(points, (0, 0, 10, 10)).first()["n"] == len(inside)
    assert ids(search.search_point(points, 7.5, 7.5)) >= set(range(1000, 1300))
    got = [r["id"] for r in search.knn_filter(points, 7.5, 7.5, 5, F.col("tag") == "a").collect()]
    assert got == _knn(points, [(0, 7.5, 7.5)], 5, lambda p: p[3] == "a")[0]
    assert search.knn_filter(points, 0, 0, 0).count() == 0 and search.knn_filter(points, 0, 0, 10_000).count() == 1101
    assert search.nearest(points, 7.5, 7.5).first()["dist"] == 0.0
    words = spark.createDataFrame([(1, 1.0, 1.0, "An APPLE"), (2, 1.0, 1.0, "bad"), (3, 1.0, 1.0, "BAD"), (4, 1.0, 1.0, None), (5, 90.0, 1.0, "apple")], "id long, x float, y float, t string")
    assert ids(search.text_search(words, (0, 0, 2, 2), "t", ["apple", "google"], ["bad"])) == {1, 2}
    assert search.contains_entries(points.select("x", "y", "tag"), points.filter("tag IS NULL"), ["x", "y", "tag"]).count() == 1


def test_range_filter_reaches_the_reader(spark, points, tmp_path):
    points.write.parquet(str(tmp_path / "p"))
    df = search.range_filter(spark.read.parquet(str(tmp_path / "p")), (0, 0, 10, 10)).select("id")
    assert "GreaterThanOrEqual(x" in pushed_filters(df) and set(read_columns(df)) == {"id", "x", "y"}


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 4.0, 2.0)], "x1 float, y1 float, x2 float, y2 float")
    a = G.box()
    one = lambda c: df.select(c).first()[0]
    assert one(G.area(a)) == 8 and one(G.width(a)) == 4 and one(G.height(a)) == 2
    assert one(G.contains(a, G.point(4.0, 2.0))) and not one(G.wraps(a, G.point(4.0, 2.0))) and not one(G.wraps(a, G.box(0.0, 0.5, 1.0, 1.0)))
    assert one(G.intersects(a, G.box(4.0, 2.0, 9.0, 9.0))) and not one(G.intersects(a, G.box(4.5, 0.0, 9.0, 9.0)))
    assert one(G.distance_squared(a, G.point(7.0, 6.0))) == 25 and one(G.distance(a, G.point(1.0, 1.0))) == 0 and one(G.distance(G.point(0.0, 0.0), G.point(3.0, 4.0))) == 5
    assert one(G.intersection_area(a, G.box(3.0, 1.0, 9.0, 9.0))) == 1 and one(G.intersection_area(a, G.box(5.0, 5.0, 6.0, 6.0))) == 0
    assert one(G.edge_gap(a, G.box(7.0, 6.0, 9.0, 9.0))) == 3 and one(G.box_distance(a, G.box(7.0, 6.0, 9.0, 9.0))) == 5
    assert one(G.expand_area(a, G.box(0.0, 0.0, 5.0, 2.0))) == 2 and one(G.area_ratio(a, G.box(0.0, 0.0, 8.0, 2.0))) == 0.5
    assert tuple(one(G.as_struct(G.normalize(G.box(5.0, 5.0, 1.0, 7.0))))) == (1, 5, 5, 7)
    assert not one(G.contains(G.box(5.0, 5.0, 1.0, 7.0), G.point(3.0, 6.0)))
    assert [one(G.is_finite(G.point(F.lit(v), F.lit(1.0)))) for v in (1.0, NAN, INF, None)] == [True, False, False, False]
    assert df.limit(0).agg(*G.mbr("x1", "y1")).first()[0] is None


def test_hilbert(spark):
    order = 4
    side = 1 << order
    cells = spark.range(side * side).select((F.col("id") % side).alias("cx"), F.floor(F.col("id") / side).alias("cy"))
    rows = cells.withColumn("h", hilbert_index(F.col("cx"), F.col("cy"), order)).withColumn("b", hilbert_cell(F.col("h"), order)).collect()
    at = {r["h"]: (r["cx"], r["cy"]) for r in rows}
    assert sorted(at) == list(range(side * side)) and all((r["b"]["cx"], r["b"]["cy"]) == (r["cx"], r["cy"]) for r in rows)
    assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(side * side - 1))
    for box in ((3, 2, 9, 12), (0, 0, 15, 15), (5, 5, 5, 5), (9, 0, 3, 3)):
        ranges = hilbert_ranges(*box, order)
        inside = sorted(h for h, (x, y) in at.items() if box[0] <= x <= box[2] and box[1] <= y <= box[3])
        assert [h for a, b in ranges for h in range(a, b + 1)] == inside


def test_bits(spark):
    df = spark.createDataFrame([(0b1011_0110,)], "v long")
    got = df.select(bits.set_bit(F.col("v"), 0), bits.clear_bit(F.col("v"), 1), bits.get_bit(F.col("v"), 3), bits.get_bits(F.col("v"), 4, 4), bits.count_bits(F.col("v")), bits.count_bits_below(F.col("v"), 4), bits.bit_string(F.col("v"))).first()
    assert tuple(got) == (0b1011_0111, 0b1011_0100, False, 0b1011, 5, 2, "10110110")


def test_store(spark):
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    base = spark.createDataFrame([(12.0, 12.0, 5), (17.0, 18.0, 6), (None, 1.0, 7)], "x float, y float, v long")
    new = spark.createDataFrame([(12.0, 12.0, 1), (17.0, 18.0, 12), (20.0, 21.0, 100)], "x float, y float, v long")
    assert rows(store.put(base, new)) == rows(spark.createDataFrame([(12.0, 12.0, 1), (17.0, 18.0, 12), (20.0, 21.0, 100), (None, 1.0, 7)], base.schema))
    summed = store.multiput(base, new, merge=lambda n, old, fresh: old + fresh)
    assert {r["v"] for r in summed.collect()} == {6, 18, 100, 7}
    general = store.multiput(base, new, merge=lambda n, old, fresh: F.greatest(old, fresh), fresh=lambda n, v: v * 2)
    assert {r["v"] for r in general.collect()} == {5, 12, 200, 7}
    assert rows(store.put(base, new.limit(0))) == rows(base) and rows(store.put(base.limit(0), new)) == rows(new)
    assert store.get(base, x=12.0, y=12.0).first()["v"] == 5 and store.get(base, x=1.0, y=1.0).count() == 0
    assert {r["v"] for r in store.multiget(base, new.unionByName(new)).collect()} == {5, 6}
    assert {r["v"] for r in store.delete(base, new).collect()} == {7}
    twice = store.insert_all(base, base)
    assert twice.count() == 6 and store.remove_all(twice, base).count() == 3
    assert store.differences(base, base).count() == 0 and store.differences(base, new).count() == 6
    assert store.build(twice, "v", partitions=3).count() == 3 and store.build(twice, "v", partitions=3).rdd.getNumPartitions() == 3
    assert {r["s"] for r in store.insert_merged(twice, s=F.sum("v")).collect()} == {10, 12, 14}
    assert store.values(store.map_values(base, v=F.col("v") * 2)).agg(F.sum("v")).first()[0] == 36
    assert store.build_with_partitioner(base, F.col("v") % 2, 2).rdd.getNumPartitions() == 2


def test_grids_and_partitions(spark, points, boxes):
    placed = points.filter("x < 100")
    g = grids.Grid(4.0)
    assert grids.cell_counts(placed, g).agg(F.sum("n")).first()[0] == placed.count()
    assert grids.partition_counts(placed, g, 7).agg(F.max("pid")).first()[0] <= 6
    cover = g.cover(boxes.filter("bid < 6 AND bid <> 4"), outer=True)
    assert cover.filter("bid = 2").first()["cx"] is None and cover.filter("bid = 3").count() == 1
    assert grids.physical_partition_counts(placed).agg(F.sum("n")).first()[0] == placed.count()
    assert abs(grids.square_grid(500).side ** 2 * 500 - 360 * 180) < 1e-6
    tree = partitioning.quadtree_for(placed, 8)
    counts = partitioning.leaf_counts(placed, tree)
    assert counts.agg(F.sum("n")).first()[0] == placed.count()
    spread = partitioning.repartition_by_quadtree(placed, tree, 8)
    assert spread.count() == placed.count() and spread.rdd.getNumPartitions() == 8
    meets = partitioning.box_leaves(boxes.filter("bid = 1"), tree)
    held = partitioning.with_leaf(joins.sjoin(placed, boxes.filter("bid = 1")), tree).select("leaf").distinct()
    assert held.join(meets.select("leaf"), "leaf", "left_anti").count() == 0
    packed = partitioning.pack_leaves(tree.weight, 4)
    assert (np.diff(packed) >= 0).all() and packed.max() <= 3
    load = partitioning.pack_by_load(np.array([100, 1, 1, 1, 97]), np.array([0, 0, 0, 0, 0]), 2)
    assert load[0] != load[4]


def test_filter_has_no_false_negatives(spark, points, boxes):
    g = grids.Grid(1.0)
    finite = boxes.filter("bid not in (6, 8, 9)")
    cells = sfilter.train(points, g)
    let = {r["bid"] for r in sfilter.may_contain(finite, cells, g, "bid").collect()}
    assert {b for b, _ in _pairs(points, boxes)} <= let and 5 not in let and 2 not in let
    coarse = {r["bid"] for r in sfilter.may_contain(finite, sfilter.coarsen(cells, 4), grids.Grid(4.0), "bid").collect()}
    assert let <= coarse
    assert sfilter.encoded_count(sfilter.encode(cells, g)).first()["n"] == cells.count()
    share = {r["bid"]: r["fraction"] for r in sfilter.empty_fraction(finite, cells, g, "bid").collect()}
    assert share[5] == 1.0 and share[3] is None and 0 <= share[1] < 1
    assert 5 in {r["bid"] for r in sfilter.mostly_empty(finite, cells, g, "bid", 0.9).collect()}
    assert sfilter.mark_empty(cells, g, (-180, -90, 180, 90)).count() == 0


def test_kmeans(spark):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.normal(0, 1, (50, 2)) + c for c in ((0, 0), (40, 40), (-40, 20))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x float, y float")
    step = {r["cluster"]: r for r in kmeans.lloyd_step(df, [(1.0, 1.0), (30.0, 30.0), (-30.0, 30.0)]).collect()}
    assert {c: r["n"] for c, r in step.items()} == {0: 50, 1: 50, 2: 50} and abs(step[1]["x"] - xy[50:100, 0].mean()) < 1e-3
    dispersion, centres = kmeans.kmeans(df, 3, restarts=4)
    assert dispersion < 400 and len(centres) == 3
    assert kmeans.kmeans(df.limit(0), 3) == (0.0, [])
    assert kmeans.ml_kmeans(df, 3).select("cluster").distinct().count() <= 3


def test_kmeans_runs_all_starts_to_the_end(spark):
    rng = np.random.default_rng(12)
    xy = rng.uniform(-50, 50, (400, 2)).astype(np.float32)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x float, y float").persist()
    got = kmeans.kmeans(df, 5, restarts=6, seed=3)
    each = []
    for n in range(6):
        centres = [(float(a), float(b)) for a, b in df.select("x", "y").orderBy(F.rand(3 + n)).limit(5).collect()]
        c, before = np.array(centres), np.inf
        for _ in range(100):
            d2 = ((xy.astype(float)[:, None] - c) ** 2).sum(axis=2)
            own, now = d2.argmin(axis=1), d2.min(axis=1).sum()
            c = np.array([xy[own == k].astype(float).mean(axis=0) if (own == k).any() else c[k] for k in range(5)])
            if abs(before - now) <= 1e-4:
                break
            before = now
        each.append((now, c))
    want = min(each, key=lambda e: e[0])
    assert abs(got[0] - want[0]) < 1e-3 and np.allclose(got[1], want[1], atol=1e-4)
    assert got[0] < kmeans.kmeans(df, 5, restarts=1, most=2, seed=3)[0]


def test_kmeans_fit_is_registered_with_the_whole_job(monkeypatch):
    from loomspace.queries import spatial

    seen = {}
    monkeypatch.setattr(spatial, "points", lambda spark, d: None)
    monkeypatch.setattr(spatial.kmeans, "kmeans", lambda points, k, **given: seen.update(given) or (0.0, []))

    class Session:
        def createDataFrame(self, rows, schema):
            return rows

    spatial.kmeans_fit(Session(), "")
    assert seen == {"restarts": 25, "tolerance": 1e-4, "most": 100}
