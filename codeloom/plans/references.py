"""Registered queries of problem 2."""

from __future__ import annotations

from codeloom.operators import references as R
from codeloom.sources.tables import load


def p2_found(spark, d):
    found = R.orphan_ends(load(spark, d, "edges_raw"), load(spark, d, "nodes"), load(spark, d, "node_deletions"))
    return found.select("edge_id", "side", "reason").distinct()


def p2_counts(spark, d):
    return R.orphan_counts(load(spark, d, "edges_raw"), load(spark, d, "nodes"), load(spark, d, "node_deletions"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}

_CASES = """
WITH e AS (SELECT DISTINCT edge_id, rel_type, emitted_at, source_id, target_id FROM edges_raw),
ends AS (
  SELECT edge_id, rel_type, emitted_at, 'source' AS side, source_id AS k FROM e
  UNION ALL SELECT edge_id, rel_type, emitted_at, 'target', target_id FROM e),
real AS (SELECT * FROM ends WHERE k IS NOT NULL AND NOT starts_with(k, 'external::')),
ev AS (SELECT id, indexed_at AS at, 0 AS del FROM nodes UNION ALL SELECT id, deleted_at, 1 FROM node_deletions),
f AS (SELECT id, min(indexed_at) AS first_seen FROM nodes GROUP BY id),
gone AS (SELECT DISTINCT id FROM node_deletions),
last AS (
  SELECT r.edge_id, r.side, max_by(ev.del, ev.at) AS del
  FROM real r JOIN gone g ON r.k = g.id JOIN ev ON ev.id = r.k AND ev.at <= r.emitted_at GROUP BY 1, 2),
cases AS (
  SELECT r.edge_id, r.rel_type, r.emitted_at, r.side,
    CASE WHEN f.id IS NULL THEN 'missing' WHEN f.first_seen > r.emitted_at THEN 'late'
         WHEN l.del = 1 THEN 'deleted' END AS reason
  FROM real r LEFT JOIN f ON f.id = r.k LEFT JOIN last l ON l.edge_id = r.edge_id AND l.side = r.side)
"""

ORACLE = {
    "p2_found": _CASES + "SELECT DISTINCT edge_id, side, reason FROM cases WHERE reason IS NOT NULL",
    "p2_counts": _CASES
    + """SELECT 'edges_raw' AS table_name, rel_type, side, strftime(emitted_at, '%Y-%m') AS month, count(*) AS n_ends,
      count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'late') AS n_late,
      count(*) FILTER (reason = 'deleted') AS n_deleted FROM cases GROUP BY ALL""",
}
