"""Clusters, nearest vectors and top N."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.llm.rpforest import Groups, fit_forest, nearest_vectors
from loomspace.llm.spectral import CellGrid, _start, _unpack, affinities, anchored_groups, cell_links, exact_links, fitted_centres, fold_cells, labelled, power_iterate, spectral_clusters, spectral_labels, trimmed
from loomspace.llm.topn import top_n_per_group

# top N --------------------------------------------------------------------------------------------------------------


def _best(rows, n):
    groups = {}
    for g, item, score in set(rows):
        if g is not None and item is not None and score is not None and not math.isnan(score):
            groups.setdefault(g, {})
            groups[g][item] = max(score, groups[g].get(item, -math.inf))
    return {(g, i, s, r + 1) for g, own in groups.items() for r, (i, s) in enumerate(sorted(own.items(), key=lambda e: (-e[1], e[0]))[:n])}


def test_top_n(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaaaab"), rng.randrange(400), rng.choice([1.0, 2.0, -1.0, math.nan, None, 7.5, math.inf])) for _ in range(3000)]
    rows += [("c", 1, 5.0), ("c", 1, 6.0), ("d", 9, 0.0), ("d", 8, -0.0), (None, 1, 1.0), ("e", None, 1.0), ("f", 1, None)]
    df = spark.createDataFrame(rows, "g string, item long, score double").withColumn("rank", F.lit("x")).withColumn("__salt", F.lit(1))
    got = {tuple(r) for r in top_n_per_group(df, ["g"], "score", "item", 3, salts=4).collect()}
    assert got == _best(rows, 3)
    assert top_n_per_group(df, ["g"], "score", "item", 0).count() == 0
    several = spark.createDataFrame([("a", 1, float(s)) for s in range(10, 30)] + [("a", 2, 7.0), ("a", 3, 6.0)], "g string, item long, score double")
    assert {r["item"] for r in top_n_per_group(several, ["g"], "score", "item", 3, salts=1).collect()} == {1, 2, 3}
    assert top_n_per_group(df.limit(0), ["g"], "score", "item", 3).count() == 0


# nearest vectors ----------------------------------------------------------------------------------------------------


def _brute(queries, data, k):
    data = sorted({r for r in data if None not in r and all(map(math.isfinite, r[1:]))})
    out = set()
    for q in {r for r in queries if None not in r and all(map(math.isfinite, r[1:]))}:
        near = sorted((sum((a - b) ** 2 for a, b in zip(q[1:], r[1:], strict=True)), r[0]) for r in data)
        out |= {(q[0], i) for _, i in near[:k]}
    return out


def test_nearest_vectors_are_exact(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.normal(size=(3000, 2)) * 20))]
    data += [(10_000 + i, 1.0, 1.0) for i in range(1500)] + data[:50] + [(5, None, 1.0), (None, 1.0, 1.0), (20_000, math.nan, 0.0), (20_001, math.inf, 0.0)]
    queries = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.normal(size=(60, 2)) * 25))] + [(100, 1.0, 1.0), (101, 1.0, 1.0), (101, 1.0, 1.0), (102, 500.0, 500.0), (103, None, 0.0), (104, math.nan, 0.0)]
    q = spark.createDataFrame(queries, "qid long, x double, y double").withColumn("rank", F.lit(0)).withColumn("d2", F.lit(0))
    d = spark.createDataFrame(data, "id long, x double, y double").withColumn("__leaf", F.lit(0))
    got = [tuple(r) for r in nearest_vectors(q, d, "qid", "id", ["x", "y"], 5, leaf_size=32, visits=3).select("qid", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(queries, data, 5)
    near = {tuple(r) for r in nearest_vectors(q, d, "qid", "id", ["x", "y"], 5, leaf_size=32, visits=6, exact=False).select("qid", "id").collect()}
    want = _brute(queries, data, 5)
    assert len(near & want) / len(want) >= 0.9


def test_nearest_vectors_in_more_dimensions_and_small_tables(spark):
    rng = np.random.default_rng(2)
    data = [(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(800, 6)))]
    names = [f"v{i}" for i in range(6)]
    d = spark.createDataFrame(data, "id long, " + ", ".join(f"{n} double" for n in names))
    q = d.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    got = {tuple(r) for r in nearest_vectors(q, d, "qid", "id", names, 4, leaf_size=50).select("qid", "id").collect()}
    assert got == _brute([r for r in data if r[0] % 20 == 0], data, 4)
    few = nearest_vectors(q, d.limit(2), "qid", "id", names, 4)
    assert few.count() == 2 * q.count()
    assert nearest_vectors(q, d.limit(0), "qid", "id", names, 4).count() == 0
    assert nearest_vectors(q.limit(0), d, "qid", "id", names, 4).count() == 0


def test_forest_search_visits_nearest_leaf_first():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2000, 3))
    forest = fit_forest(v, 2000, trees=2, leaf_size=100)
    leaves = forest.file(v)
    some = np.arange(0, 2000, 100)
    row, tree, leaf = forest.search(v[some], 6)
    near, at = forest.within(v[some], np.full(len(some), 0.2))
    for n, i in enumerate(some):
        seen = list(zip(tree[row == n].tolist(), leaf[row == n].tolist(), strict=True))
        assert len(set(seen)) == len(seen) == 6 and (0, leaves[i, 0]) in seen and (1, leaves[i, 1]) in seen
        close = {int(leaves[j, 0]) for j in np.flatnonzero(((v - v[i]) ** 2).sum(axis=1) <= 0.04)}
        assert close <= set(at[near == n].tolist())
    row, tree, leaf = forest.search(v[:3], 1000)  # more visits than leaves: each leaf once
    assert all(len(set(zip(tree[row == n], leaf[row == n], strict=True))) == (row == n).sum() == 2 * forest.leaves for n in range(3))


def test_groups_are_bounded_and_meet_once():
    """However full a leaf is and however many queries visit it, a group stays small, and each query meets each row of its leaf once."""
    rng = np.random.default_rng(6)
    held, asked = rng.integers(0, 30, (2, 64)), rng.integers(0, 5, (2, 64))
    held[0, 7], asked[0, 7], asked[1, 9], held[1, 20] = 5000, 900, 4000, 0
    groups = Groups(held, asked, 100)
    tree, leaf = (np.repeat(a.ravel(), held.ravel()) for a in np.indices(held.shape))
    q_tree, q_leaf = (np.repeat(a.ravel(), asked.ravel()) for a in np.indices(held.shape))
    row, g = groups.data(tree, leaf, rng.integers(0, 1 << 31, len(tree)))
    q_row, q_g = groups.queries(q_tree, q_leaf, rng.integers(0, 1 << 31, len(q_tree)))
    assert np.bincount(g).max() <= 350 and np.bincount(q_g).max() <= 350
    met = {}
    for r, group in zip(row.tolist(), g.tolist(), strict=True):
        met.setdefault(group, []).append(r)
    seen = [(q, r) for q, group in zip(q_row.tolist(), q_g.tolist(), strict=True) for r in met.get(group, []) if (tree[r], leaf[r]) == (q_tree[q], q_leaf[q])]
    assert len(seen) == len(set(seen)) == int((held * asked).sum())


def test_a_popular_and_crowded_place(spark):
    """A third of the data in one leaf and most queries at it, with groups far smaller than the leaf."""
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=(400, 2)) * 50, rng.normal(size=(300, 2)) * 0.001])
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(v)]
    queries = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(150, 2)) * 0.001)] + [(900, 40.0, 40.0)]
    got = nearest_vectors(spark.createDataFrame(queries, "qid long, x double, y double"), spark.createDataFrame(data, "id long, x double, y double"), "qid", "id", ["x", "y"], 5, leaf_size=16, max_depth=2, group_rows=40)
    assert {tuple(r) for r in got.select("qid", "id").collect()} == _brute(queries, data, 5)


# clusters -----------------------------------------------------------------------------------------------------------


def _rings(rng):
    """Three groups of different shape within a moat, and thin ground."""
    t = rng.uniform(0, 2 * np.pi, 250)
    ring = np.stack([np.cos(t) * 3 + 10, np.sin(t) * 3 + 10], axis=1)
    line = np.stack([rng.uniform(-30, -24, 150), rng.normal(0, 0.05, 150)], axis=1)
    blob = rng.normal(0, 0.3, (400, 2)) + [40, -20]
    ground = rng.uniform([-170, -80], [170, 80], (300, 2))
    return np.concatenate([ring, line, blob, ground]).astype(np.float32).astype(np.float64)


def _reached(xy, start, reach):
    seen = ((xy - start) ** 2).sum(axis=1) <= reach * reach
    while True:
        near = (((xy[:, None] - xy[None, seen]) ** 2).sum(axis=2) <= reach * reach).any(axis=1)
        if (near <= seen).all():
            return seen
        seen |= near


def test_anchored_groups_equal_brute_force(spark):
    xy = _rings(np.random.default_rng(8))
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    anchors = [(1, 13.0, 10.0), (2, -27.0, 0.0), (3, 40.0, -20.0), (4, 0.0, 89.0), (5, None, 0.0), (3, 40.0, -20.0)]
    dirty = [*rows, *rows[:40], (9001, None, 1.0), (None, 10.0, 10.0), (9002, math.nan, 0.0), (9003, 500.0, 0.0)]
    p = spark.createDataFrame(dirty, "id long, x float, y float").withColumn("cluster", F.lit("x")).withColumn("n", F.lit("x")).withColumn("cx", F.lit("x"))
    a = spark.createDataFrame(anchors, "anchor_id long, x float, y float")
    got = [tuple(r) for r in anchored_groups(p, a, 0.85).collect()]
    want = {(n, int(i)) for n, x, y in anchors if x is not None for i in np.flatnonzero(_reached(xy, np.float32([x, y]).astype(np.float64), 0.85))}
    assert len(got) == len(set(got)) and set(got) == want


def test_groups_of_empty_tables(spark):
    p = spark.createDataFrame([], "id long, x float, y float")
    a = spark.createDataFrame([(1, 0.0, 0.0)], "anchor_id long, x float, y float")
    one = spark.createDataFrame([(7, 0.5, 0.0)], "id long, x float, y float")
    assert anchored_groups(p, a, 0.85).count() == 0
    assert anchored_groups(one, a.limit(0), 0.85).count() == 0
    assert [tuple(r) for r in anchored_groups(one, a, 0.85).collect()] == [(1, 7)]
    assert spectral_clusters(p, 0.85).count() == 0


def _settled(spark, points, grid, rounds=1, **options):
    cells = fold_cells(points, grid).persist()
    linked, further = affinities(cells, points, grid, options.get("tile", 96))
    v = None
    for n in range(rounds):
        v = power_iterate(linked, further, grid.reach, v, shift=n % 2 * (options.get("tile", 96) // 2), **options)
    return cells, v


def test_tiles_don_t_change_the_settled_vectors(spark):
    xy = _rings(np.random.default_rng(9))
    grid = CellGrid(0.85)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in xy], "x float, y float")
    cells, wide = _settled(spark, df, grid, steps=400)
    _, small = _settled(spark, df, grid, rounds=16, steps=200, halo=6, tile=9)
    wide = {(r["cx"], r["cy"]): np.frombuffer(r["v"], np.float32) for r in wide.collect()}
    small = {(r["cx"], r["cy"]): (np.frombuffer(r["v"], np.float32), r["gap"]) for r in small.collect()}
    # the same cells agree, whatever the tiles; a group cut by tiles settles at a value of its own
    pdf = cells.toPandas()
    cx, cy = pdf["cx"].to_numpy(np.int64), pdf["cy"].to_numpy(np.int64)
    a, b, d2 = cell_links(cx, cy, np.stack(pdf["rx"]), np.stack(pdf["ry"]), 0.85)
    assert wide.keys() == small.keys() and max(g for _, g in small.values()) < 1e-3
    at = list(zip(cx.tolist(), cy.tolist(), strict=True))
    assert all(np.allclose(small[at[i]][0], small[at[j]][0], atol=1e-3) for i, j in zip(a, b, strict=True))
    # against powers of a dense matrix
    m = np.eye(len(pdf))
    m[a, b] = m[b, a] = np.exp(-d2 / 0.85**2)
    m /= m.sum(axis=1, keepdims=True)
    for _ in range(14):
        m = m @ m
    v = m @ _start(cx, cy, 4)
    assert all(np.allclose(wide[c], v[i], atol=1e-3) for i, c in enumerate(at))


def test_all_records_are_asked_where_extremes_don_t_link(spark):
    """Two combs that mesh: their nearest records are none of the extreme ones."""
    rng = np.random.default_rng(5)
    grid = CellGrid(1.0, (0.0, 0.0, 20.0, 20.0))
    for gap in (0.999, 1.001):
        a = [(x, y) for x, y in rng.uniform([0.02, 0.02], [0.2, 0.68], (300, 2))] + [(0.3, 0.35), (0.02, 0.0), (0.02, 0.7)]
        b = [(1.45 + x, y) for x, y in rng.uniform(0.0, [0.2, 0.7], (300, 2))] + [(0.3 + gap, 0.35)]
        xy = np.array(a + b)
        df = spark.createDataFrame([(float(x), float(y)) for x, y in xy], "x double, y double")
        cells = fold_cells(df, grid)
        linked, further = affinities(cells, df, grid)
        got = {tuple(r)[:4]: r["d2"] for r in further.collect()}
        c = np.floor(xy / grid.side).astype(int)
        near = {}
        for i in range(len(a)):
            for j in range(len(a), len(xy)):
                d2 = (xy[i, 0] - xy[j, 0]) ** 2 + (xy[i, 1] - xy[j, 1]) ** 2
                k = (*c[i].tolist(), *c[j].tolist())
                near[k] = min(near.get(k, 9.0), d2)
        for k, d2 in got.items():
            assert math.isclose(near.get(k, near.get((*k[2:], *k[:2]))), d2)
        groups = spectral_clusters(df.withColumn("id", F.monotonically_increasing_id()), 1.0, extent=(0.0, 0.0, 20.0, 20.0)).count()
        assert groups == (1 if gap < 1 else 2)


def test_exact_links_of_nothing(spark):
    grid = CellGrid(0.85)
    df = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    _, further = affinities(fold_cells(df, grid), df, grid)
    assert further.count() == 0
    assert exact_links(spark.createDataFrame([], "cx int, cy int, px int, py int, x1 double, y1 double, x2 double, y2 double, px1 double, py1 double, px2 double, py2 double"), df, grid).count() == 0


def test_labels_decide_the_groups(spark):
    """A hash in place of the spectral labels must not give the groups; nor may linkage alone leave a settled group in two."""
    xy = _rings(np.random.default_rng(8))
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x float, y float")
    a = spark.createDataFrame([(1, 13.0, 10.0), (2, -27.0, 0.0), (3, 40.0, -20.0)], "anchor_id long, x float, y float")
    with pytest.raises(RuntimeError):
        anchored_groups(p, a, 0.85, most_rounds=2, labels=lambda v, centres, tolerance: v.withColumn("cluster", F.pmod(F.xxhash64("cx", "cy"), F.lit(1 << 30)).cast("int")))


def test_a_group_wider_than_its_tile_takes_several_rounds(spark):
    xy = [(0.5 * i, 10.0 + 0.1 * (i % 3)) for i in range(64)] + [(50.0, 10.0), (50.5, 10.0)]
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    a = spark.createDataFrame([(1, 0.2, 10.0), (2, 50.1, 10.0)], "anchor_id long, x double, y double")
    rounds = []
    got = {tuple(r) for r in anchored_groups(p, a, 0.85, tile=12, labels=lambda v, centres, t: rounds.append(1) or labelled(v, centres, t)).collect()}
    assert got == {(1, i) for i in range(64)} | {(2, 64), (2, 65)} and len(rounds) > 2


def test_clusters_are_pure_and_whole_before_the_trim(spark):
    xy = _rings(np.random.default_rng(8))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    grid = CellGrid(0.85)
    cells = fold_cells(df, grid)
    got = spectral_labels(cells, df, grid).toPandas()
    of = dict(zip(zip(got["cx"], got["cy"], strict=True), got["cluster"], strict=True))
    size = got.groupby("cluster")["n"].sum()
    for start in ((13.0, 10.0), (-27.0, 0.0), (40.0, -20.0)):
        own = np.flatnonzero(_reached(xy, np.array(start), 0.85))
        c = np.floor((xy[own] + [180, 90]) / grid.side).astype(int)
        names = {of[tuple(r)] for r in c.tolist()}
        assert len(names) == 1 and len(own) / size[names.pop()] >= 0.95


def test_parts_are_joined_across_tiles(spark):
    """A snake of cells through many tiles is one part; a second cluster beside it another."""
    xy = [(0.5 * i, 20.0) for i in range(200)] + [(0.5 * i, 40.0) for i in range(200)] + [(99.5, 20.0 + 0.5 * i) for i in range(41)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    grid = CellGrid(0.85)
    cells = fold_cells(df, grid)
    linked, _ = affinities(cells, df, grid)
    rows = linked.withColumn("cluster", F.when(F.col("cx") < 350, F.lit(1)).otherwise(F.lit(2)))
    got = trimmed(rows, grid, tile=4).toPandas()
    assert got["part"].nunique() == 3 and got.groupby("part")["cluster"].nunique().max() == 1
    one = trimmed(linked.withColumn("cluster", F.lit(0)), grid, tile=4)
    assert one.select("part").distinct().count() == 1 and one.filter("leak").count() == 0
    assert got.loc[got["leak"], "cx"].between(347, 352).all()


def test_centres_lie_on_settled_groups(spark):
    df = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(90)], "id long, x double, y double").withColumn("x", F.col("x") * 30)
    grid = CellGrid(0.85)
    _, v = _settled(spark, df, grid)
    centres = fitted_centres(v, 4)
    assert len(centres) == 3 and labelled(v, centres).filter("cluster % 2 = 0").select("cluster").distinct().count() == 3
    assert len(fitted_centres(v.limit(0), 4)) == 0
    assert all(len(_unpack(b, 4)) for b in [v.toPandas()["v"]])


def test_spectral_clusters_find_the_groups(spark):
    rng = np.random.default_rng(10)
    xy = np.concatenate([rng.normal(0, 0.4, (n, 2)) + c for n, c in ((300, (0, 0)), (200, (20, 20)), (120, (-40, 10)), (80, (60, -50)))])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame([*rows, *rows[:30]], "id long, x float, y float")
    got = sorted(spectral_clusters(df, 0.85).collect(), key=lambda r: -r["records"])
    assert sum(r["records"] for r in got) == len(rows) and [r["records"] for r in got] == [300, 200, 120, 80]
    for r, centre in zip(got, ((0, 0), (20, 20), (-40, 10), (60, -50)), strict=True):
        assert len(r["typical"]) == 5
        assert max(math.dist(xy[i], centre) for i in r["typical"]) < 0.5


def test_clusters_are_linked_groups_on_thin_ground(spark):
    xy = _rings(np.random.default_rng(8))
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    at = np.array([r[1:] for r in rows])
    want, left = [], set(range(len(at)))
    while left:
        own = set(np.flatnonzero(_reached(at, at[min(left)], 0.85)).tolist())
        want.append(len(own))
        left -= own
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = spectral_clusters(df, 0.85).collect()
    assert sorted(r["records"] for r in got) == sorted(want)
    assert all(len(r["typical"]) == min(5, r["records"]) for r in got)
