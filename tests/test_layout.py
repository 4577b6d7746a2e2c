"""Layout on disk, bounded groups, encoded filters, prepared joins and filters below the dedupe."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.operators import grid as grids
from loomspace.operators import joins, knn, partitioning, search, sfilter, skew
from loomspace.operators.proximity import Parts, region_join
from loomspace.operators.quadtree import build_quadtree
from loomspace.plans.inspect import plan_text, pushed_filters
from loomspace.plans.runtime import clear_tables, materialize


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(21)
    rows = [(i, float(np.float32(x)), float(np.float32(y))) for i, (x, y) in enumerate(np.concatenate([rng.uniform([-170, -80], [170, 80], (1500, 2)), rng.normal([20, 20], 0.5, (700, 2))]))]
    df = spark.createDataFrame(rows, "id long, x float, y float").persist()
    df.rows = rows
    return df


def test_a_box_reads_only_the_folders_it_touches(spark, places, tmp_path):
    tree = partitioning.quadtree_for(places, 16)
    partitioning.write_layout(places.withColumn("note", F.lit("x")), tree, 16, str(tmp_path / "t"))
    box = (18.0, 18.0, 19.0, 22.5)
    got = partitioning.read_layout(spark, str(tmp_path / "t"), box)
    want = {i for i, x, y in places.rows if box[0] <= x <= box[2] and box[1] <= y <= box[3]}
    assert {r["id"] for r in got.collect()} == want and got.columns == ["id", "x", "y", "note"]
    assert len(got.inputFiles()) <= 16 and partitioning.read_layout(spark, str(tmp_path / "t")).count() == len(places.rows)
    assert re.search(r"PartitionFilters: \[[^\]]*pid", plan_text(got)) and "LessThanOrEqual(x,19.0)" in pushed_filters(got)
    read = spark.read.parquet(str(tmp_path / "t" / "layout")).filter((F.col("x1") <= box[2]) & (F.col("x2") >= box[0]) & (F.col("y1") <= box[3]) & (F.col("y2") >= box[1])).count()
    assert 0 < read < 16
    assert partitioning.read_layout(spark, str(tmp_path / "t"), (200.0, 0.0, 300.0, 1.0)).count() == 0
    audit = partitioning.leaf_audit(places, tree, 200).first()
    assert tuple(audit) == (len(places.rows), 0, 0)


def test_registered_range_queries_filter_before_they_shuffle(spark):
    from loomspace.queries import spatial

    for query in (spatial.range_count, spatial.range_filter, spatial.range_fold, spatial.spatial_text):
        df = query(spark, "/root/testdata/sf0.001")
        assert "GreaterThanOrEqual(x,-60.0)" in pushed_filters(df), query.__name__


def test_nearest_keys_of_a_table_with_copies(spark, places):
    rows = [*places.rows, *places.rows[:900], *[places.rows[3]] * 50]
    px, py = places.rows[3][1:]
    near = search.knn_distinct(spark.createDataFrame(rows, "id long, x float, y float"), px, py, 6)
    want = sorted((float(np.hypot(np.float64(np.float32(x) - np.float32(px)), np.float64(np.float32(y) - np.float32(py)))), i) for i, x, y in places.rows)[:6]
    assert [r["id"] for r in near.collect()] == [i for _, i in want]
    assert search.knn_distinct(places.limit(0), 0.0, 0.0, 3).count() == 0 and search.knn_distinct(places, 0.0, 0.0, 0).count() == 0
    assert search.knn_distinct(places, 0.0, 0.0, 5000).count() == len(places.rows)


def test_parts_meet_once_and_stay_small():
    """A leaf with many objects and many regions: every pair in one group, no group with many of either."""
    objects, regions = np.array([10.0, 5000.0, 3.0]), np.array([4.0, 900.0, 0.0])
    parts = Parts(objects, regions, 100, 50)
    rng = np.random.default_rng(3)
    leaf_o, leaf_r = np.repeat([0, 1, 2], objects.astype(int)), np.repeat([0, 1], [4, 900])
    row_o, group_o = parts.of(leaf_o, rng.integers(0, 1 << 31, len(leaf_o)), False)
    row_r, group_r = parts.of(leaf_r, rng.integers(0, 1 << 31, len(leaf_r)), True)
    assert np.bincount(group_o).max() <= 160 and np.bincount(group_r).max() <= 90
    assert all(parts.leaf(g) == leaf_o[r] for r, g in zip(row_o[::97].tolist(), group_o[::97].tolist(), strict=True))
    in_group = np.bincount(group_o, minlength=int(parts.first[-1])) @ np.bincount(group_r, minlength=int(parts.first[-1]))
    assert in_group == 10 * 4 + 5000 * 900


@pytest.mark.parametrize("predicate", ["contains", "intersects", "within"])
def test_many_regions_on_one_spot(spark, places, predicate):
    regions = [(i, 19.9 + i * 1e-5, 19.9, 20.1, 20.1 + i * 1e-5) for i in range(600)] + [(9000, -170.0, -80.0, 170.0, 80.0)]
    left = spark.createDataFrame(regions, "id long, x1 double, y1 double, x2 double, y2 double")
    right = places.select("id", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), F.col("x").cast("double").alias("x2"), F.col("y").cast("double").alias("y2"))
    got = [tuple(r) for r in region_join(left, right, predicate, distance=0.3, target=100, most_regions=40).collect()]
    if predicate == "within":
        want = {(a, i) for a, x1, y1, _, _ in regions for i, x, y in places.rows if (x1 - x) ** 2 + (y1 - y) ** 2 <= 0.3 * 0.3}
    else:
        want = {(a, i) for a, x1, y1, x2, y2 in regions for i, x, y in places.rows if x1 <= x <= x2 and y1 <= y <= y2}
    assert len(got) == len(set(got)) and set(got) == want


def test_cover_equals_all_pairs():
    rng = np.random.default_rng(9)
    tree = build_quadtree(rng.normal(0, 20, 3000), rng.normal(0, 20, 3000), 0.002)
    x, y = rng.uniform(-180, 170, 200), rng.uniform(-90, 80, 200)
    w, h = rng.exponential(5, (2, 200))
    row, leaf = tree.cover(x, y, x + w, y + h)
    a, b = tree.grid(x, y)
    c, d = tree.grid(x + w, y + h)
    lx, ly, hx, hy = tree.grid_boxes()
    want = {(i, j) for i in range(200) for j in np.flatnonzero((a[i] <= hx) & (c[i] >= lx) & (b[i] <= hy) & (d[i] >= ly)).tolist()}
    assert set(zip(row.tolist(), leaf.tolist(), strict=True)) == want and len(row) == len(want)


def test_leaf_statistics_stay_small_however_small_the_parts(spark, places, monkeypatch):
    """What the driver gets is a row a leaf, not a row a part."""
    seen = []
    stats = knn.leaf_stats
    monkeypatch.setattr(knn, "leaf_stats", lambda df, leaf: seen.append(stats(df, leaf)) or seen[-1])
    asked = spark.createDataFrame([(1, 20.0, 20.0), (2, -100.0, 5.0), (3, 20.1, 19.9)], "qid long, qx float, qy float")
    got = {(r["qid"], r["id"]) for r in knn.knn_join(places, asked, 4, target=8, max_leaves=64).collect()}
    assert seen[0].count() <= 64
    assert {(r["qid"], r["id"]) for r in knn.knn_join(places, asked, 4, target=8, max_leaves=64, most_queries=1).collect()} == got
    want = set()
    for q, qx, qy in ((1, 20.0, 20.0), (2, -100.0, 5.0), (3, 20.1, 19.9)):
        d = sorted((float(np.float64(np.float32(x) - np.float32(qx)) ** 2 + np.float64(np.float32(y) - np.float32(qy)) ** 2), i) for i, x, y in places.rows)
        want |= {(q, i) for _, i in d[:4]}
    assert got == want


def test_prepared_joins_equal_plain_ones(spark, places):
    boxes = spark.createDataFrame([(i, float(i - 5), float(i), float(i + 20), float(i + 15)) for i in range(30)] + [(99, 5.0, 5.0, 1.0, 1.0)], "bid long, x1 float, y1 float, x2 float, y2 float")
    p, b = joins.prepare_places(places, boxes, 4), joins.prepare_boxes(boxes, 4)
    assert {r["id"] for r in joins.prepared_sjoin(p, b).collect()} == {r["id"] for r in joins.sjoin(places, boxes).collect()}
    n = {"n": F.count(F.lit(1))}
    for how in ("left", "inner"):
        a, c = joins.prepared_rjoin(p, b, boxes, "bid", n, {"n": F.lit(0)}, how), joins.rjoin(places, boxes, "bid", n, {"n": F.lit(0)}, how)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, c.collect()))


def test_bitmaps_say_the_same_as_cells(spark, places):
    grid = grids.Grid(0.5)
    cells = sfilter.train(places, grid)
    bits = sfilter.encode(cells, grid)
    assert bits.count() > 1
    assert {tuple(r) for r in sfilter.decode(bits, grid).collect()} == {tuple(r) for r in cells.collect()}
    boxes = spark.createDataFrame([(i, x, y, x + 0.3, y + 0.2) for i, (x, y) in enumerate(np.random.default_rng(2).uniform([-180, -90], [179, 89], (300, 2)).tolist())] + [(900, 5.0, 5.0, 1.0, 1.0), (901, None, 0.0, 1.0, 1.0)], "bid long, x1 float, y1 float, x2 float, y2 float")
    want = {r["bid"] for r in sfilter.may_contain(boxes, cells, grid, "bid").collect()}
    for most in (1 << 25, 0):  # broadcast or not
        assert {r["bid"] for r in sfilter.may_contain_encoded(boxes, bits, grid, "bid", most).collect()} == want
    assert sfilter.may_contain_encoded(boxes, sfilter.encode(cells.limit(0), grid), grid, "bid").count() == 0


def test_cut_divides_the_heaviest_groups(spark):
    counts = spark.createDataFrame([(i, 10 + i % 3, 2) for i in range(100)] + [(500, 100_000, 3), (501, 60_000, 5)], "g long, n long, visits long")
    cut = {r["g"]: r["parts"] for r in skew.optimal_cut(counts).collect()}
    assert {500, 501} <= cut.keys() and cut[500] > 1
    assert skew.optimal_cut(counts.limit(0)).count() == 0 and skew.optimal_cut(counts.filter("g < 1")).count() == 0


def test_tables_can_be_cleared(spark, places):
    kept = materialize(places.select("id"))
    file = kept.inputFiles()[0].removeprefix("file://")
    assert kept.count() == len(places.rows) and os.path.exists(file)
    clear_tables(spark)
    assert not os.path.exists(file)
