"""Queries over the event logs, with their SQL."""

from __future__ import annotations

from strandwork.operators import events as v
from strandwork.plans.data_problems import _SPACE
from strandwork.sources.tables import table

_AGENT = f"regexp_replace(lower(agent), '^{_SPACE}|{_SPACE}$', '', 'g')"
_M = f"m AS (SELECT DISTINCT event_id, ts, event, tool, ms, {_AGENT} AS agent, agent_version FROM mcp_events)"
_L = f"l AS (SELECT DISTINCT lease_id, ts, event, depth, to_depth, density, {_AGENT} AS agent FROM lease_events)"
_OK = "ms IS NOT NULL AND NOT isnan(ms) AND ms >= 0"


def events_tool_stats(spark, d):
    return v.tool_stats(table(spark, d, "mcp_events"))


def events_agent_stats(spark, d):
    return v.agent_stats(table(spark, d, "mcp_events"))


def events_trajectory(spark, d):
    return v.trajectory(table(spark, d, "lease_events"))


def events_recovery(spark, d):
    return v.recovery(table(spark, d, "mcp_events"), table(spark, d, "lease_events"))


def events_stability(spark, d):
    return v.stability(table(spark, d, "lease_events"))


def events_stale_episodes(spark, d):
    return v.stale_episodes(table(spark, d, "mcp_events"), table(spark, d, "lease_events"))


def events_lease_states(spark, d):
    return v.lease_states(table(spark, d, "mcp_events"))


QUERIES = {f.__name__: f for f in (events_tool_stats, events_agent_stats, events_trajectory, events_recovery, events_stability, events_stale_episodes, events_lease_states)}
SQL = {
    "events_tool_stats": f"""WITH {_M} SELECT tool, count(*) AS n, CAST(sum(CASE WHEN event = 'tool_error' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors,
CAST(floor(avg(CASE WHEN {_OK} THEN ms END) + 0.5) AS BIGINT) AS avg_ms, max(CASE WHEN {_OK} THEN ms END) AS max_ms FROM m WHERE tool IS NOT NULL GROUP BY tool""",
    "events_agent_stats": f"""WITH {_M} SELECT coalesce(agent, 'unknown') AS agent, count(*) AS n, count(DISTINCT tool) AS n_tools, count(DISTINCT agent_version) AS n_versions, min(ts) AS first_ts, max(ts) AS last_ts FROM m GROUP BY 1""",
    "events_trajectory": f"""WITH {_L}, k AS (SELECT coalesce(agent, 'unknown') AS agent, CASE WHEN NOT isnan(density) AND density > 0 THEN density END AS d FROM l WHERE event IN ('degraded', 'stale'))
SELECT agent, count(d) AS n_samples, round(avg(d), 12) AS avg_density, max(d) AS max_density, CAST(sum(CASE WHEN d >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS n_bursts FROM k GROUP BY agent""",
    "events_recovery": f"""WITH {_M}, {_L}, o AS (SELECT agent, ts FROM m WHERE tool = 'orient' AND event = 'tool_call' AND agent IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT lease_id, agent, ts FROM l WHERE event = 'stale' AND agent IS NOT NULL AND ts IS NOT NULL), j AS (SELECT s.*, (SELECT min(o.ts) FROM o WHERE o.agent = s.agent AND o.ts > s.ts) AS recovered_at FROM s)
SELECT *, (epoch_us(recovered_at) - epoch_us(ts)) / 1000.0 AS recovery_ms FROM j""",
    "events_stability": f"""WITH {_L}, k AS (SELECT * FROM l WHERE agent IS NOT NULL AND ts IS NOT NULL)
SELECT a.lease_id, a.agent, a.ts, (SELECT min(b.ts) FROM k b WHERE b.agent = a.agent AND b.ts > a.ts AND b.event IN ('degraded', 'stale')) AS degraded_at FROM k a WHERE a.event = 'orient_reset'""",
    "events_stale_episodes": f"""WITH {_M}, {_L}, e AS (
SELECT agent, ts, 0 AS kind, lease_id AS id, coalesce(to_depth, depth, 1) AS depth FROM l WHERE event IN ('stale', 'depth_escalate') AND agent IS NOT NULL AND ts IS NOT NULL
UNION ALL SELECT agent, ts, CASE WHEN tool = 'orient' THEN 2 ELSE 1 END, event_id, NULL FROM m WHERE tool IS NOT NULL AND agent IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY agent ORDER BY ts, kind, id ROWS UNBOUNDED PRECEDING) - CASE WHEN kind = 2 THEN 1 ELSE 0 END AS episode FROM e),
s AS (SELECT agent, episode, min((ts, kind, id)) AS st, max(depth) AS depth FROM r WHERE kind = 0 GROUP BY 1, 2)
SELECT s.agent, CAST(s.episode AS BIGINT) AS episode, min(s.st[1]) AS start_ts, min(s.depth) AS depth, count(r.id) AS calls_before_orient
FROM s LEFT JOIN r ON r.agent = s.agent AND r.episode = s.episode AND r.kind = 1 AND (r.ts, r.kind, r.id) > s.st GROUP BY 1, 2""",
}
