"""SQL twins of the data problems that belong to the core."""

from __future__ import annotations

N = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
REST = rf"(?:\s+{N}){{0,2}}"
PREFIX = r"^\s*(?:SRID\s*=\s*[0-9]+\s*;\s*)?"
POINT = rf"{PREFIX}POINT\s*(?:ZM|Z|M)?\s*\(\s*({N})\s+({N}){REST}\s*\)\s*$"
RING = (
    rf"{PREFIX}POLYGON\s*(?:ZM|Z|M)?\s*\(\s*\(\s*({N})\s+({N}){REST}\s*,\s*{N}\s+{N}{REST}\s*,\s*({N})\s+({N}){REST}"
    rf"(?:\s*,\s*{N}\s+{N}{REST})+\s*\)\s*\)\s*$"
)


def number(column: str, pattern: str, group: int) -> str:
    return f"TRY_CAST(regexp_extract({column}, '{pattern}', {group}, 'i') AS FLOAT) + CAST(0 AS FLOAT)"


#: Common table expression ``geo(id, x1, y1, x2, y2, is_point, value)`` of the readable entries, each id once.
GEO = f"""raw AS (
  SELECT entry_id AS id, {number("geom", POINT, 1)} AS a, {number("geom", POINT, 2)} AS b, {number("geom", POINT, 1)} AS c, {number("geom", POINT, 2)} AS d, TRUE AS is_point, value FROM entries
  UNION ALL
  SELECT entry_id, {number("geom", RING, 1)}, {number("geom", RING, 2)}, {number("geom", RING, 3)}, {number("geom", RING, 4)}, FALSE, value FROM entries
), geo AS (
  SELECT id, min(least(a, c)) AS x1, min(least(b, d)) AS y1, min(greatest(a, c)) AS x2, min(greatest(b, d)) AS y2, bool_and(is_point) AS is_point, min(value) AS value
  FROM raw WHERE a BETWEEN -180 AND 180 AND c BETWEEN -180 AND 180 AND b BETWEEN -90 AND 90 AND d BETWEEN -90 AND 90 GROUP BY id
)"""

EDGES = "edges AS (SELECT box_id, min(x + CAST(0 AS FLOAT)) AS x FROM boxes WHERE isfinite(x) GROUP BY box_id)"

SQL = {
    "p2_found": f"""WITH {GEO}, {EDGES},
places AS (SELECT x1, y1, count(*) AS n FROM geo WHERE is_point GROUP BY x1, y1),
lefts AS (SELECT x, count(*) AS n FROM edges GROUP BY x)
SELECT 'entry_geom' AS field, CAST(CAST(x1 AS DOUBLE) * 64 AS BIGINT) AS kx, CAST(CAST(y1 AS DOUBLE) * 64 AS BIGINT) AS ky
FROM places WHERE n >= CAST(0.02 AS DOUBLE) * (SELECT sum(n) FROM places)
UNION ALL
SELECT 'box_x', CAST(CAST(x AS DOUBLE) * 64 AS BIGINT), CAST(0 AS BIGINT) FROM lefts WHERE n >= CAST(0.02 AS DOUBLE) * (SELECT sum(n) FROM lefts)""",
    "p2_totals": f"""WITH {GEO}, {EDGES}
SELECT 'entry_geom' AS field, CAST(x1 AS DOUBLE) AS x, CAST(y1 AS DOUBLE) AS y, count(*) AS rows,
  round(sum(CASE WHEN NOT isnan(value) THEN value END), 2) AS total
FROM geo WHERE is_point GROUP BY x1, y1
UNION ALL
SELECT 'box_x', CAST(x AS DOUBLE), NULL, count(*), NULL FROM edges GROUP BY x""",
    "p4_found": f"""WITH {GEO},
b AS (SELECT DISTINCT box_id, x, y, x2, y2 FROM boxes WHERE isfinite(x) AND isfinite(y) AND isfinite(x2) AND isfinite(y2)),
p AS (SELECT DISTINCT id, x, y FROM points WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90),
s AS (SELECT DISTINCT station_id, x, y FROM stations WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90)
SELECT 'box' AS kind, box_id AS left_id, id AS right_id FROM b JOIN p ON p.x BETWEEN b.x AND b.x2 AND p.y BETWEEN b.y AND b.y2
UNION ALL
SELECT 'near', station_id, id FROM s JOIN p ON p.x BETWEEN s.x - 1 AND s.x + 1 AND p.y BETWEEN s.y - 1 AND s.y + 1
  AND (CAST(s.x AS DOUBLE) - CAST(p.x AS DOUBLE)) * (CAST(s.x AS DOUBLE) - CAST(p.x AS DOUBLE))
    + (CAST(s.y AS DOUBLE) - CAST(p.y AS DOUBLE)) * (CAST(s.y AS DOUBLE) - CAST(p.y AS DOUBLE)) <= CAST(0.15625 AS DOUBLE) * CAST(0.15625 AS DOUBLE)
UNION ALL
SELECT 'entry', box_id, id FROM b JOIN geo ON geo.x1 >= b.x AND geo.x2 <= b.x2 AND geo.y1 >= b.y AND geo.y2 <= b.y2""",
}
