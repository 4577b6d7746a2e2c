"""All registered queries of the core."""

from __future__ import annotations

from loomspace.queries import problems, problems_sql, spatial, spatial_sql, tables

QUERIES = spatial.QUERIES | tables.QUERIES | {"p2_found": problems.p2_found, "p2_totals": problems.p2_totals, "p4_found": problems.p4_found}
SQL = spatial_sql.SQL | tables.SQL | problems_sql.SQL
