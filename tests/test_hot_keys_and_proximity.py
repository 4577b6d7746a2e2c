"""Totals of hot keys and joins of places with regions, against plain Python."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspace.operators.hot_keys import frequent_keys, key_totals, one_row_per_id
from loomspace.operators.proximity import region_join
from loomspace.operators.quadtree import build_quadtree
from loomspace.operators.rtree import PackedRTree


def test_totals_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([1.0, -2.5, None])) for i in range(2000)]
    rows += rows[:100] + [(None, "hot", 1.0)]
    df = spark.createDataFrame(rows, "id long, k string, v double").withColumn("n", F.lit("x")).withColumn("__id", F.lit("x"))
    once = one_row_per_id(df, "id", {"k": F.col("k"), "v": F.col("v")})
    got = {r["k"]: (r["n"], r["s"]) for r in key_totals(once, ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v")}).collect()}
    want = {}
    for i, k, v in {r for r in rows if r[0] is not None}:
        if k is not None:
            n, s = want.get(k, (0, None))
            want[k] = (n + 1, s if v is None else (s or 0.0) + v)
    assert got == want
    assert {r["k"] for r in frequent_keys(once, ["k"], 0.5).collect()} == {"hot"}
    assert {r["k"] for r in frequent_keys(once, ["k"], 0.0).collect()} == {"hot", "a", "b"}
    assert frequent_keys(once.limit(0), ["k"], 0.02).count() == 0


def test_hot_keys_shuffle_only_partial_states(spark):
    plan = key_totals(spark.range(100).withColumn("k", F.lit(1)), ["k"], {"n": F.count(F.lit(1))})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "partial_count" in plan


# joins --------------------------------------------------------------------------------------------------------------

BOXES = [(1, 0.0, 0.0, 10.0, 10.0), (2, 5.0, 5.0, 4.0, 9.0), (3, 3.0, 3.0, 3.0, 3.0), (4, None, 0.0, 1.0, 1.0), (5, math.nan, 0.0, 1.0, 1.0), (6, -180.0, -90.0, 180.0, 90.0), (7, 200.0, 100.0, 300.0, 200.0), (1, 0.0, 0.0, 10.0, 10.0), (8, -1.0, 3.0, 4.0, 3.0), (None, 0.0, 0.0, 9.0, 9.0)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x1 float, y1 float, x2 float, y2 float").withColumn("part", F.lit("x")).withColumn("left_id", F.lit("x"))


def _sane(rows):
    return {r for r in rows if r[0] is not None and all(v is not None and not math.isnan(v) for v in r[1:]) and r[1] <= r[3] and r[2] <= r[4]}


@pytest.mark.parametrize("predicate", ["contains", "intersects", "within"])
def test_region_join_equals_nested_loop(spark, predicate):
    rng = np.random.default_rng(3)
    objects = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(np.round(rng.uniform(-12, 12, (600, 4)) * np.array([1, 1, 0.1, 0.1]), 1).astype(np.float32).astype(float))]
    objects += [(10_000 + i, 3.0, 3.0, 3.0, 3.0) for i in range(500)] + objects[:20] + [(9, None, 0.0, 0.0, 0.0), (None, 1.0, 1.0, 1.0, 1.0), (20_000, 10.0, 10.0, 10.0, 10.0)]
    as_float = {(r[0], *(float(np.float32(v)) for v in r[1:])) for r in _sane(objects)}
    want = set()
    for b in _sane(BOXES):
        for o in as_float:
            ok = {
                "contains": b[1] <= o[1] and o[3] <= b[3] and b[2] <= o[2] and o[4] <= b[4],
                "intersects": b[1] <= o[3] and o[1] <= b[3] and b[2] <= o[4] and o[2] <= b[4],
                "within": (b[1] - o[1]) ** 2 + (b[2] - o[2]) ** 2 <= 6.25,
            }[predicate]
            if ok:
                want.add((b[0], o[0]))
    got = [tuple(r) for r in region_join(_frame(spark, BOXES), _frame(spark, objects), predicate, distance=2.5, target=64).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_region_join_of_empty_tables(spark):
    some = _frame(spark, BOXES)
    assert region_join(some.limit(0), some, "contains").count() == 0
    assert region_join(some, some.limit(0), "intersects").count() == 0
    with pytest.raises(ValueError):
        region_join(some, some, "touches")


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 120), st.integers(1, 40))
def test_rtree_probe(seed, n, m):
    rng = np.random.default_rng(seed)
    b = np.round(rng.uniform(0, 10, (n, 4)))
    b[:, 2:] = b[:, :2] + b[:, 2:] / 4
    q = np.round(rng.uniform(0, 10, (m, 4)))
    q[:, 2:] = q[:, :2] + q[:, 2:] / 8
    got = sorted((int(i), int(j)) for i, j in zip(*map(np.concatenate, zip(*PackedRTree(*b.T).probe(*q.T, batch=7, most=64), strict=True)), strict=True)) if n else []
    want = [(i, j) for i in range(m) for j in range(n) if b[j, 0] <= q[i, 2] and q[i, 0] <= b[j, 2] and b[j, 1] <= q[i, 3] and q[i, 1] <= b[j, 3]]
    if n == 0 or not want:
        return
    assert got == want


def test_quadtree_leaves_partition_the_plane():
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 20, 4000).clip(-180, 180), rng.normal(0, 20, 4000).clip(-90, 90)
    tree = build_quadtree(x, y, leaf_share=0.02, max_leaves=200)
    assert len(tree) <= 200 and abs(tree.weight.sum() - 1) < 1e-9
    leaf = tree.leaf(x, y)
    boxes = np.array(tree.bounds())
    own = boxes[leaf]
    assert ((own[:, 0] <= x) & (x <= own[:, 2]) & (own[:, 1] <= y) & (y <= own[:, 3])).all()
    assert np.bincount(leaf, minlength=len(tree)).max() <= 0.03 * len(x)
    assert abs(((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])).sum() - 360 * 180) < 1e-3
    row, found = tree.cover(x, y, x, y)
    assert (found == leaf).all() and (row == np.arange(len(x))).all()
