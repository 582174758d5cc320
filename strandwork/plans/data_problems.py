"""Queries p1, p2, p3, p5 and p7 over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators import hierarchy, quantiles, references, sessions, tree_aggregation
from strandwork.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy_roots(table(spark, d, "inheritance_edges"))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy_paths(table(spark, d, "inheritance_edges"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy_descendants(table(spark, d, "inheritance_edges"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return tree_aggregation.wrong_fan_in(table(spark, d, "nodes"), table(spark, d, "edges"))


def p2_callers(spark: SparkSession, d: str) -> DataFrame:
    return tree_aggregation.fan_in_report(table(spark, d, "nodes"), table(spark, d, "edges")).select("id", "fan_in", "n_callers")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.slow_days(table(spark, d, "mcp_events"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.tool_percentiles(table(spark, d, "mcp_events"))


def p3_rank_check(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.rank_check(table(spark, d, "mcp_events"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_sessions(spark, d).select("agent", "start_us", "end_us", "n_mcp", "n_lease")


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.agent_sessions(table(spark, d, "mcp_events"), table(spark, d, "lease_events"))


def _parents(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("nodes", "file_hashes")}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return references.broken_references(table(spark, d, "edges"), _parents(spark, d)).drop("observed_at")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.broken_reference_counts(table(spark, d, "edges"), _parents(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p2_found, p2_callers, p3_found, p3_percentiles, p3_rank_check, p5_found, p5_sessions, p7_found, p7_counts)}

_LINKS = """
e AS (SELECT DISTINCT parent_id AS p, child_id AS c FROM inheritance_edges WHERE parent_id IS NOT NULL AND child_id IS NOT NULL),
reach AS (SELECT c, p FROM e UNION SELECT e.c, reach.p FROM e JOIN reach ON e.p = reach.c),
"""
_WALK = """
walk AS (
  SELECT e.c, e.p AS root, 1 AS depth, [e.c, e.p] AS up FROM e WHERE e.p NOT IN (SELECT c FROM e)
  UNION ALL
  SELECT e.c, walk.root, depth + 1, list_prepend(e.c, up) FROM walk JOIN e ON e.p = walk.c WHERE NOT list_contains(up, e.c)
),
"""
_P7 = """
WITH r AS (
  SELECT DISTINCT edge_id, observed_at, ref_field, tab, key FROM (
    SELECT edge_id, observed_at, 'caller_id' AS ref_field, 'n' AS tab, caller_id AS key FROM edges
    UNION ALL SELECT edge_id, observed_at, 'callee_id', 'n', callee_id FROM edges
    UNION ALL SELECT edge_id, observed_at, 'callee_file', 'f', callee_file FROM edges) u
  WHERE key IS NOT NULL
), p AS (
  SELECT 'n' AS tab, id AS key, indexed_at AS born, deleted_at AS gone FROM nodes
  UNION ALL SELECT 'f', file_path, first_seen_at, removed_at FROM file_hashes
), f AS (
  SELECT r.edge_id, r.ref_field, r.observed_at,
    CASE WHEN p.key IS NULL THEN 'missing' WHEN p.born > r.observed_at THEN 'late' WHEN p.gone <= r.observed_at THEN 'deleted' END AS reason
  FROM r LEFT JOIN p ON r.tab = p.tab AND r.key = p.key
)
"""
_MEASURED = """
WITH m AS (
  SELECT DISTINCT event_id, tool, strftime(ts, '%Y-%m-%d') AS ev_day, ms FROM mcp_events
  WHERE tool IS NOT NULL AND ts IS NOT NULL AND ms IS NOT NULL AND NOT isnan(ms) AND ms >= 0
)
"""


_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _sessions(columns: str) -> str:
    return f"""
WITH r AS (
  SELECT DISTINCT 'm' AS log, event_id AS id, regexp_replace(lower(agent), '^{_SPACE}|{_SPACE}$', '', 'g') AS agent, epoch_us(ts) AS us, NULL AS event FROM mcp_events
  UNION SELECT DISTINCT 'l', lease_id, regexp_replace(lower(agent), '^{_SPACE}|{_SPACE}$', '', 'g'), epoch_us(ts), event FROM lease_events
), k AS (SELECT * FROM r WHERE agent IS NOT NULL AND us IS NOT NULL
), g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY agent ORDER BY us)
), s AS (SELECT *, sum(fresh) OVER (PARTITION BY agent ORDER BY us RANGE UNBOUNDED PRECEDING) AS no FROM g)
SELECT agent, min(us) AS start_us, max(us) AS end_us, {columns}
FROM s GROUP BY agent, no
"""


_COUNTS = "count(DISTINCT CASE WHEN log = 'm' THEN id END) AS n_mcp, count(DISTINCT CASE WHEN log = 'l' THEN id END) AS n_lease"

SQL = {
    "p1_found": f"""WITH RECURSIVE {_LINKS} {_WALK}
loops AS (SELECT DISTINCT c FROM reach WHERE c = p)
SELECT c AS class_id, root AS root_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY c, root
UNION ALL SELECT c, '', -1 FROM loops
UNION ALL SELECT DISTINCT c, '', -2 FROM reach WHERE p IN (SELECT c FROM loops) AND c NOT IN (SELECT c FROM loops)""",
    "p1_paths": f"""WITH RECURSIVE {_LINKS} {_WALK}
best AS (SELECT c, root, min(struct_pack(depth := depth, up := up)) AS b FROM walk GROUP BY c, root)
SELECT c AS class_id, root AS root_id, CAST(b.depth AS INTEGER) AS depth, array_to_string(list_reverse(b.up), ' > ') AS path FROM best""",
    "p1_descendants": """WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS p, child_id AS c FROM inheritance_edges WHERE parent_id IS NOT NULL AND child_id IS NOT NULL),
w AS (SELECT p AS a, c AS b, [p, c] AS path, 1 AS depth FROM e UNION ALL SELECT w.a, e.c, list_append(path, e.c), depth + 1 FROM w JOIN e ON e.p = w.b WHERE w.b <> w.a AND (e.c = w.a OR NOT list_contains(path, e.c)))
SELECT a AS class_id, b AS descendant_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2""",
    "p2_found": """WITH n AS (SELECT callee_id, count(DISTINCT caller_id) AS n FROM edges GROUP BY callee_id)
SELECT DISTINCT id FROM nodes LEFT JOIN n ON id = callee_id WHERE is_external = 0 AND (fan_in IS NULL OR fan_in <> coalesce(n, 0))""",
    "p2_callers": """WITH n AS (SELECT callee_id, count(DISTINCT caller_id) AS n FROM edges GROUP BY callee_id)
SELECT DISTINCT id, fan_in, coalesce(n, 0) AS n_callers FROM nodes LEFT JOIN n ON id = callee_id""",
    "p3_found": f"""{_MEASURED}, a AS (SELECT tool, quantile_disc(ms, 0.5) AS w FROM m GROUP BY tool),
b AS (SELECT tool, ev_day, count(*) AS n, quantile_disc(ms, 0.5) AS q FROM m GROUP BY tool, ev_day)
SELECT b.tool, b.ev_day FROM b JOIN a ON a.tool = b.tool WHERE n >= 20 AND q > 2 * w""",
    "p3_rank_check": f"""{_MEASURED}, u AS (SELECT tool, ev_day FROM m UNION ALL SELECT tool, 'all' FROM m)
SELECT tool, ev_day, count(*) AS n, true AS p50_ok, true AS p90_ok, true AS p95_ok, true AS p99_ok FROM u GROUP BY 1, 2""",
    "p5_found": _sessions(_COUNTS),
    "p5_sessions": _sessions(
        "CAST(max(us) - min(us) AS DOUBLE) / 1000000.0 AS duration_s, " + _COUNTS
        + "".join(f", count(DISTINCT CASE WHEN event = '{e}' THEN id END) AS n_{e}" for e in sessions.LEASE_EVENTS)
    ),
    "p7_found": f"{_P7} SELECT DISTINCT edge_id, ref_field, reason FROM f WHERE reason IS NOT NULL",
    "p7_counts": f"""{_P7} SELECT ref_field, reason, strftime(observed_at, '%Y-%m-%d') AS day, count(DISTINCT edge_id) AS n
FROM f WHERE reason IS NOT NULL GROUP BY ALL""",
}
