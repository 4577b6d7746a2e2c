"""SQL twins of the spatial queries, for DuckDB."""

from __future__ import annotations

from loomspace.queries.problems_sql import GEO, POINT, number
from loomspace.queries.spatial import BOX, CENTRES, EDGE_BOX, PLACE, K

P = "p AS (SELECT id, min(x) AS x, min(y) AS y, min(tag) AS tag, min(text) AS text FROM points WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 GROUP BY id)"
B = "b AS (SELECT box_id AS bid, min(x) AS x1, min(y) AS y1, min(x2) AS x2, min(y2) AS y2 FROM boxes WHERE isfinite(x) AND isfinite(y) AND isfinite(x2) AND isfinite(y2) GROUP BY box_id)"
S = "q AS (SELECT station_id AS qid, min(x) AS qx, min(y) AS qy FROM stations WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 GROUP BY station_id)"
STORE = f"{P}, s AS (SELECT x, y, min(id) AS id FROM p GROUP BY x, y)"
NEW = f"{STORE}, {S}, n AS (SELECT x, y, min(id) AS id FROM (SELECT x, y, -id AS id FROM s WHERE id % 3 = 0 UNION ALL SELECT qx, qy, min(qid) FROM q GROUP BY qx, qy) GROUP BY x, y)"
DX, DY = "CAST(p.x - q.qx AS DOUBLE)", "CAST(p.y - q.qy AS DOUBLE)"
XY = "CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y"
INSIDE = "p.x >= b.x1 AND p.x <= b.x2 AND p.y >= b.y1 AND p.y <= b.y2"


def f(v: float) -> str:
    return f"CAST({v!r} AS FLOAT)"


def d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def inside(box: tuple[float, float, float, float]) -> str:
    return f"x >= {f(box[0])} AND x <= {f(box[2])} AND y >= {f(box[1])} AND y <= {f(box[3])}"


def dist(px: str, py: str) -> str:
    return f"sqrt(CAST(x - {px} AS DOUBLE) * CAST(x - {px} AS DOUBLE) + CAST(y - {py} AS DOUBLE) * CAST(y - {py} AS DOUBLE))"


def knn(where: str = "TRUE", what: str = "qid, id, dist, rk") -> str:
    return f"""WITH {P}, {S}, r AS (
  SELECT qid, id, sqrt({DX} * {DX} + {DY} * {DY}) AS dist, row_number() OVER (PARTITION BY qid ORDER BY sqrt({DX} * {DX} + {DY} * {DY}), id) AS rk
  FROM q, p WHERE {where})
SELECT {what} FROM r WHERE rk <= {K}"""


def cell(c: str, low: float, side: float, n: int) -> str:
    return f"CAST(least(greatest(floor((CAST({c} AS DOUBLE) - {d(low)}) / {d(side)}), 0), {n - 1}) AS INTEGER)"


def cells(side: float, x: str = "x", y: str = "y") -> str:
    return f"{cell(x, -180.0, side, int(360 / side))} AS cx, {cell(y, -90.0, side, int(180 / side))} AS cy"


def hilbert_sql(order: int) -> str:
    """Row count of each place along the curve, one step of the published cell-to-curve recursion for each bit."""
    side = 1 << order
    out = f"""WITH {P}, h{order} AS (SELECT CAST(least(greatest(floor((CAST(x AS DOUBLE) + 180) / {d(360.0)} * {side}), 0), {side - 1}) AS BIGINT) AS a,
  CAST(least(greatest(floor((CAST(y AS DOUBLE) + 90) / {d(180.0)} * {side}), 0), {side - 1}) AS BIGINT) AS b, CAST(0 AS BIGINT) AS h FROM p)"""
    for k in range(order - 1, -1, -1):
        s = 1 << k
        rx, ry = f"((a >> {k}) & 1)", f"((b >> {k}) & 1)"
        flip = lambda v: f"CASE WHEN {ry} = 0 AND {rx} = 1 THEN {side - 1} - {v} ELSE {v} END"
        out += f""", h{k} AS (SELECT CASE WHEN {ry} = 0 THEN {flip("b")} ELSE a END AS a, CASE WHEN {ry} = 0 THEN {flip("a")} ELSE b END AS b, h + {s * s} * xor(3 * {rx}, {ry}) AS h FROM h{k + 1})"""
    return f"{out} SELECT h, count(*) AS n FROM h0 GROUP BY h"


NEAREST = dist(f(PLACE[0]), f(PLACE[1]))
BX1, BY1, BX2, BY2 = map(f, BOX)
MEETS = f"(x1 <= {BX2} AND {BX1} <= x2 AND y1 <= {BY2} AND {BY1} <= y2)"
CELL_COUNTS = f"{P}, c AS (SELECT {cells(4.0)}, count(*) AS n FROM p GROUP BY ALL)"
FILTER = f"{P}, f AS (SELECT DISTINCT {cells(1.0)} FROM p)"
COVER1 = f"""{B}, k AS (SELECT b.*, unnest(range({cell("x1", -180.0, 1.0, 360)}, {cell("x2", -180.0, 1.0, 360)} + 1)) AS cx FROM b WHERE x1 <= x2 AND y1 <= y2),
m AS (SELECT k.*, unnest(range({cell("y1", -90.0, 1.0, 180)}, {cell("y2", -90.0, 1.0, 180)} + 1)) AS cy FROM k)"""
PX, PY = map(f, PLACE)
BDX = f"CAST(CASE WHEN {PX} < x1 THEN x1 - {PX} WHEN {PX} <= x2 THEN 0 ELSE {PX} - x2 END AS DOUBLE)"
BDY = f"CAST(CASE WHEN {PY} < y1 THEN y1 - {PY} WHEN {PY} <= y2 THEN 0 ELSE {PY} - y2 END AS DOUBLE)"
RJOIN = f"WITH {P}, {B}, h AS (SELECT bid, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, round(avg(CAST(x AS DOUBLE)), 6) AS mean_x FROM b JOIN p ON {INSIDE} GROUP BY bid)"
SJOIN = f"WITH {P}, {B} SELECT id, {XY} FROM p WHERE EXISTS (SELECT 1 FROM b WHERE {INSIDE})"
PAIRS = f"WITH {P}, {B} SELECT bid, id FROM b JOIN p ON {INSIDE}"
GW, GH = "greatest(CAST(0 AS FLOAT), least(x2, {}) - greatest(x1, {}))", "greatest(CAST(0 AS FLOAT), least(y2, {}) - greatest(y1, {}))"
SHARED = f"({GW.format(BX2, BX1)} * {GH.format(BY2, BY1)})"
NEAREST_CENTRE = ", ".join(f"CAST(x - {f(a)} AS DOUBLE) * CAST(x - {f(a)} AS DOUBLE) + CAST(y - {f(b)} AS DOUBLE) * CAST(y - {f(b)} AS DOUBLE)" for a, b in CENTRES)

SQL = {
    "range_filter": f"WITH {P} SELECT id, {XY}, tag FROM p WHERE {inside(BOX)} AND tag IS NOT NULL",
    "range_filter_boundary": f"""WITH {P}, e AS (
  SELECT entry_id AS id, min(a) AS x, min(b) AS y FROM (SELECT entry_id, {number("geom", POINT, 1)} AS a, {number("geom", POINT, 2)} AS b FROM entries)
  WHERE a BETWEEN -180 AND 180 AND b BETWEEN -90 AND 90 GROUP BY entry_id)
SELECT id, {XY} FROM (SELECT id, x, y FROM p UNION ALL SELECT id, x, y FROM e) WHERE {inside(EDGE_BOX)}""",
    "range_count": f"WITH {P} SELECT count(*) AS n FROM p WHERE {inside(BOX)}",
    "range_fold": f"WITH {P} SELECT CAST(min(x) AS DOUBLE) AS x1, CAST(min(y) AS DOUBLE) AS y1, CAST(max(x) AS DOUBLE) AS x2, CAST(max(y) AS DOUBLE) AS y2, count(*) AS n FROM p WHERE {inside(BOX)}",
    "range_intersects": f"WITH {B} SELECT bid, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM b WHERE x1 <= x2 AND y1 <= y2 AND {MEETS}",
    "spatial_text": f"WITH {P} SELECT id, {XY}, text FROM p WHERE {inside(BOX)} AND (contains(lower(text), 'apple') OR contains(lower(text), 'google') OR contains(text, 'BAD'))",
    "contains_entries": f"WITH {P} SELECT DISTINCT {XY}, tag FROM p WHERE tag = 'view'",
    "knn_filter": f"WITH {P} SELECT id, {XY}, {NEAREST} AS dist FROM p ORDER BY dist, id LIMIT 10",
    "knn_filter_pred": f"WITH {P} SELECT id, {XY}, {NEAREST} AS dist FROM p WHERE tag = 'view' ORDER BY dist, id LIMIT 10",
    "nearest": f"WITH {P} SELECT id, {XY}, {NEAREST} AS dist FROM p ORDER BY dist, id LIMIT 1",
    "knn_join": knn(),
    "knn_join_pred": knn("p.x > 0 AND p.tag = 'view'"),
    "knn_join_hilbert": knn(),
    "knn_join_pivots": knn(),
    "knn_join_collected": knn(what="qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rk) AS ids") + " GROUP BY qid",
    "knn_join_approx": f"""WITH {P}, {S}, g AS (SELECT q.*, (floor(CAST(qx AS DOUBLE) / 4) + {d(0.5)}) * 4 AS mx, (floor(CAST(qy AS DOUBLE) / 4) + {d(0.5)}) * 4 AS my FROM q), r AS (
  SELECT qid, id, sqrt({DX} * {DX} + {DY} * {DY}) AS dist, row_number() OVER (PARTITION BY qid ORDER BY sqrt({DX} * {DX} + {DY} * {DY}), id) AS rk
  FROM g AS q JOIN p ON p.x BETWEEN q.mx - 6 AND q.mx + 6 AND p.y BETWEEN q.my - 6 AND q.my + 6)
SELECT qid, id, dist, rk FROM r WHERE rk <= {K}""",
    "sjoin": SJOIN,
    "sjoin_map": SJOIN.replace(f"SELECT id, {XY}", f"SELECT id, {XY}, upper(tag) AS shout"),
    "sjoin_scheduled": SJOIN,
    "rjoin_count": f"{RJOIN} SELECT b.bid, coalesce(n, 0) AS n FROM b LEFT JOIN h ON b.bid = h.bid",
    "rjoin_sum": f"{RJOIN} SELECT b.bid, coalesce(n, 0) AS n, coalesce(ids, 0) AS ids, mean_x FROM b LEFT JOIN h ON b.bid = h.bid",
    "rjoin_inner": f"{RJOIN} SELECT bid, n, ids, mean_x FROM h",
    "rjoin_pairs": PAIRS,
    "rjoin_prepared": PAIRS,
    "sjoin_prepared": SJOIN,
    "rjoin_prepared_count": f"{RJOIN} SELECT b.bid, coalesce(n, 0) AS n, coalesce(ids, 0) AS ids FROM b LEFT JOIN h ON b.bid = h.bid",
    "rjoin_custom": f"WITH {P}, {B} SELECT b.bid, coalesce(max(p.id), 0) AS last FROM b LEFT JOIN p ON {INSIDE} GROUP BY b.bid",
    "rjoin_quadtree": PAIRS,
    "rjoin_scheduled": f"{RJOIN} SELECT b.bid, coalesce(n, 0) AS n, coalesce(ids, 0) AS ids FROM b LEFT JOIN h ON b.bid = h.bid",
    "box_intersections": f"WITH {GEO}, {B} SELECT bid, id AS entry_id FROM b JOIN geo AS e ON b.x1 <= b.x2 AND b.y1 <= b.y2 AND b.x1 <= e.x2 AND e.x1 <= b.x2 AND b.y1 <= e.y2 AND e.y1 <= b.y2",
    "geom_scalars": f"""WITH {B} SELECT bid, CAST(x2 - x1 AS DOUBLE) AS w, CAST(y2 - y1 AS DOUBLE) AS h, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS a,
  CAST(least(x1, x2) AS DOUBLE) AS n_x1, CAST(least(y1, y2) AS DOUBLE) AS n_y1, CAST(greatest(x1, x2) AS DOUBLE) AS n_x2, CAST(greatest(y1, y2) AS DOUBLE) AS n_y2 FROM b""",
    "geom_predicates": f"""WITH {B} SELECT bid, x1 >= {BX1} AND x2 <= {BX2} AND y1 >= {BY1} AND y2 <= {BY2} AS inside, {MEETS} AS meets,
  x1 > {BX1} AND x2 < {BX2} AND y1 > {BY1} AND y2 < {BY2} AS wrapped, x1 = {BX1} AND x2 = {BX2} AND y1 = {BY1} AND y2 = {BY2} AS same,
  x1 <= {PX} AND {PX} <= x2 AND y1 <= {PY} AND {PY} <= y2 AS holds, x1 < {PX} AND {PX} < x2 AND y1 < {PY} AND {PY} < y2 AS holds_open, x1 < {PX} AND y1 < {PY} AS below FROM b""",
    "box_box_ops": f"""WITH {B} SELECT bid, CAST({SHARED} AS DOUBLE) AS shared,
  CAST((greatest(x2, {BX2}) - least(x1, {BX1})) * (greatest(y2, {BY2}) - least(y1, {BY1})) - (x2 - x1) * (y2 - y1) AS DOUBLE) AS growth,
  CAST(CASE WHEN {MEETS} THEN 0 ELSE least(abs(x1 - {BX2}), abs({BX1} - x2), abs(y1 - {BY2}), abs({BY1} - y2)) END AS DOUBLE) AS gap,
  sqrt(CAST(greatest(x1 - {BX2}, {BX1} - x2, 0) AS DOUBLE) * CAST(greatest(x1 - {BX2}, {BX1} - x2, 0) AS DOUBLE) + CAST(greatest(y1 - {BY2}, {BY1} - y2, 0) AS DOUBLE) * CAST(greatest(y1 - {BY2}, {BY1} - y2, 0) AS DOUBLE)) AS dist,
  CAST(greatest(x1, {BX1}) AS DOUBLE) AS ix1, CAST(least(y2, {BY2}) AS DOUBLE) AS iy2, CAST(least(x1, {BX1}) AS DOUBLE) AS ex1, CAST(greatest(y2, {BY2}) AS DOUBLE) AS ey2,
  CAST({SHARED} AS DOUBLE) / CAST(({BX2} - {BX1}) * ({BY2} - {BY1}) AS DOUBLE) AS ratio FROM b""",
    "box_point_distance": f"""WITH {B} SELECT bid, {BDX} * {BDX} + {BDY} * {BDY} AS d2, sqrt({BDX} * {BDX} + {BDY} * {BDY}) AS dist,
  sqrt(CAST(x1 - {PX} AS DOUBLE) * CAST(x1 - {PX} AS DOUBLE) + CAST(y1 - {PY} AS DOUBLE) * CAST(y1 - {PY} AS DOUBLE)) AS corner FROM b WHERE x1 <= x2 AND y1 <= y2""",
    "mbr_agg": f"WITH {P} SELECT tag, CAST(min(x) AS DOUBLE) AS x1, CAST(min(y) AS DOUBLE) AS y1, CAST(max(x) AS DOUBLE) AS x2, CAST(max(y) AS DOUBLE) AS y2, count(*) AS n FROM p GROUP BY tag",
    "build_dedup": f"WITH {STORE} SELECT {XY}, id FROM s",
    "put_overwrite": f"WITH {NEW} SELECT {XY}, id FROM n UNION ALL SELECT {XY}, id FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.x = s.x AND n.y = s.y)",
    "multiput_sum": f"WITH {NEW} SELECT CAST(coalesce(s.x, n.x) AS DOUBLE) AS x, CAST(coalesce(s.y, n.y) AS DOUBLE) AS y, CASE WHEN s.id IS NULL THEN n.id WHEN n.id IS NULL THEN s.id ELSE s.id + n.id END AS id FROM s FULL JOIN n ON s.x = n.x AND s.y = n.y",
    "multiput_general": f"WITH {NEW} SELECT CAST(coalesce(s.x, n.x) AS DOUBLE) AS x, CAST(coalesce(s.y, n.y) AS DOUBLE) AS y, CASE WHEN s.id IS NULL THEN n.id * 10 WHEN n.id IS NULL THEN s.id ELSE greatest(s.id, n.id) END AS id FROM s FULL JOIN n ON s.x = n.x AND s.y = n.y",
    "insert_merged": f"WITH {P} SELECT {XY}, count(*) AS records, max(id) AS last FROM p GROUP BY p.x, p.y",
    "point_lookup": f"WITH {P} SELECT id, {XY} FROM p WHERE p.x = 0 AND p.y = 0",
    "multiget": f"WITH {P}, {S} SELECT id, {XY} FROM p WHERE EXISTS (SELECT 1 FROM q WHERE q.qx = p.x AND q.qy = p.y) OR (p.x, p.y) IN (SELECT (o.x, o.y) FROM p AS o WHERE o.id % 5 = 0)",
    "delete_keys": f"WITH {NEW} SELECT {XY}, id FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.x = s.x AND n.y = s.y)",
    "remove_entries": f"WITH {STORE} SELECT {XY}, id FROM s WHERE id % 2 <> 0",
    "store_differences": f"""WITH {NEW}, t AS (SELECT x, y, id FROM n UNION ALL SELECT x, y, id FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.x = s.x AND n.y = s.y))
SELECT {XY}, id, 'left' AS side FROM (SELECT * FROM (SELECT x, y, id FROM s) EXCEPT SELECT * FROM t) UNION ALL SELECT {XY}, id, 'right' FROM (SELECT * FROM t EXCEPT SELECT * FROM (SELECT x, y, id FROM s))""",
    "map_values": f"WITH {STORE} SELECT id % 1000 AS id, count(*) AS n FROM s GROUP BY id % 1000",
    "grid_partition_counts": f"WITH {P} SELECT CAST((cy * 90 + cx) % 500 AS INTEGER) AS pid, count(*) AS n FROM (SELECT {cells(4.0)} FROM p) GROUP BY ALL",
    "grid_cell_counts": f"WITH {CELL_COUNTS} SELECT cx, cy, n FROM c",
    "box_cells": f"""WITH {B}, k AS (SELECT b.*, unnest(range({cell("x1", -180.0, 4.0, 90)}, {cell("x2", -180.0, 4.0, 90)} + 1)) AS cx FROM b WHERE x1 <= x2 AND y1 <= y2)
SELECT bid, CAST(cx AS INTEGER) AS cx, CAST(unnest(range({cell("y1", -90.0, 4.0, 45)}, {cell("y2", -90.0, 4.0, 45)} + 1)) AS INTEGER) AS cy FROM k""",
    "top_cells": f"WITH {CELL_COUNTS} SELECT cx, cy, n FROM c ORDER BY n DESC, cx, cy LIMIT 10",
    "sfilter_may_contain": f"WITH {FILTER}, {COVER1} SELECT DISTINCT bid FROM m JOIN f ON m.cx = f.cx AND m.cy = f.cy",
    "sfilter_empty_fraction": f"""WITH {FILTER}, {COVER1}, u AS (SELECT bid, sum(greatest(0, least(CAST(x2 AS DOUBLE), m.cx - 179) - greatest(CAST(x1 AS DOUBLE), m.cx - 180)) * greatest(0, least(CAST(y2 AS DOUBLE), m.cy - 89) - greatest(CAST(y1 AS DOUBLE), m.cy - 90))) AS held
  FROM m JOIN f ON m.cx = f.cx AND m.cy = f.cy GROUP BY bid), a AS (SELECT bid, (CAST(x2 AS DOUBLE) - CAST(x1 AS DOUBLE)) * (CAST(y2 AS DOUBLE) - CAST(y1 AS DOUBLE)) AS area FROM b)
SELECT a.bid, round(CASE WHEN area > 0 THEN 1 - coalesce(held, 0) / area END, 6) AS fraction FROM a LEFT JOIN u ON a.bid = u.bid""",
    "sfilter_mark_empty": f"WITH {FILTER} SELECT cx, cy FROM f WHERE NOT (cx - 180 >= {d(BOX[0])} AND cx - 179 <= {d(BOX[2])} AND cy - 90 >= {d(BOX[1])} AND cy - 89 <= {d(BOX[3])})",
    "sfilter_coarse": f"WITH {FILTER} SELECT DISTINCT CAST(floor(cx / 4) AS INTEGER) AS cx, CAST(floor(cy / 4) AS INTEGER) AS cy FROM f",
    "sfilter_encoded_probe": f"WITH {FILTER}, {COVER1} SELECT DISTINCT bid FROM m JOIN f ON m.cx = f.cx AND m.cy = f.cy",
    "sfilter_decoded": f"WITH {FILTER} SELECT cx, cy FROM f",
    "sfilter_mostly_empty": f"""WITH {FILTER}, {COVER1}, u AS (SELECT bid, sum(greatest(0, least(CAST(x2 AS DOUBLE), m.cx - 179) - greatest(CAST(x1 AS DOUBLE), m.cx - 180)) * greatest(0, least(CAST(y2 AS DOUBLE), m.cy - 89) - greatest(CAST(y1 AS DOUBLE), m.cy - 90))) AS held
  FROM m JOIN f ON m.cx = f.cx AND m.cy = f.cy GROUP BY bid), a AS (SELECT bid, (CAST(x2 AS DOUBLE) - CAST(x1 AS DOUBLE)) * (CAST(y2 AS DOUBLE) - CAST(y1 AS DOUBLE)) AS area FROM b)
SELECT a.bid FROM a LEFT JOIN u ON a.bid = u.bid WHERE area > 0 AND 1 - coalesce(held, 0) / area >= 0.5""",
    "quadtree_leaf_counts": f"WITH {P} SELECT count(*) AS places, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS overfull FROM p",
    "quadtree_partition_counts": f"WITH {P} SELECT CAST(16 AS BIGINT) AS partitions, count(*) AS places, TRUE AS numbered FROM p",
    "quadtree_load_partitions": f"WITH {P} SELECT CAST(16 AS BIGINT) AS partitions, count(*) AS places, TRUE AS numbered FROM p",
    "skew_report": f"""WITH {CELL_COUNTS}, m AS (SELECT quantile_disc(n, 0.5) AS median FROM c)
SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, max(n) AS largest, CAST(min(median) AS BIGINT) AS median, count(*) FILTER (n >= 3 * greatest(1, median)) AS hot FROM c, m""",
    "hilbert_order": hilbert_sql(4),
    "sfilter_encoded_count": f"WITH {FILTER} SELECT count(*) AS n FROM f",
    "hilbert_roundtrip": f"""WITH {P} SELECT DISTINCT CAST(least(greatest(floor((CAST(x AS DOUBLE) + 180) / {d(360.0)} * 1024), 0), 1023) AS BIGINT) AS cx,
  CAST(least(greatest(floor((CAST(y AS DOUBLE) + 90) / {d(180.0)} * 1024), 0), 1023) AS BIGINT) AS cy FROM p""",
    "hilbert_ranges_scan": f"""WITH {P} SELECT id, {XY} FROM p WHERE floor((CAST(p.x AS DOUBLE) + 180) / {d(360.0)} * 64) BETWEEN 20 AND 41
  AND floor((CAST(p.y AS DOUBLE) + 90) / {d(180.0)} * 64) BETWEEN 17 AND 30""",
    "kmeans_step": f"""WITH {P}, e AS (SELECT x, y, [{NEAREST_CENTRE}] AS l FROM p)
SELECT CAST(list_position(l, list_min(l)) - 1 AS BIGINT) AS cluster, count(*) AS n, round(avg(CAST(e.x AS DOUBLE)), 6) AS x, round(avg(CAST(e.y AS DOUBLE)), 6) AS y, round(sum(list_min(l)), 1) AS d2 FROM e GROUP BY 1""",
    "wkt_roundtrip": f"WITH {P} SELECT id, {XY} FROM p",
    "wkt_scan": f"WITH {GEO} SELECT id AS entry_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM geo",
    "bit_ops": f"""WITH {P} SELECT id, id | 8 AS set3, id & ~CAST(16 AS BIGINT) AS clear4, (id >> 5) & 1 = 1 AS bit5, (id >> 4) & 255 AS byte, CAST(bit_count(id) AS INTEGER) AS ones,
  CAST(bit_count(id & 4095) AS INTEGER) AS low_ones, ltrim(bin(id), '0') AS text FROM p""",
}
