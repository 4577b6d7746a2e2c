"""All registered queries of this subpackage with their SQL twins."""

from __future__ import annotations

from loomspace.llm import queries, sql

QUERIES = {name: getattr(queries, name) for name in (
    "p1_found", "p1_clusters", "p1_quality", "p3_found", "p3_neighbours", "p3_recall", "p5_found", "p6_found", "p6_containers", "p6_invariants", "p7_found", "p7_cleaned", "p7_left", "p8_found", "p8_redacted",
)}
SQL = dict(sql.SQL)
