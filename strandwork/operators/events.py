"""Analytics of the event logs: latencies, episodes, recovery, trajectories and the state of each session's lease."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.operators.ordered import as_of_forward, running_count
from strandwork.operators.sessions import agent_records  # noqa: F401 - the same records
from strandwork.util import js_round, trim_all


def _once(df: DataFrame, key: str) -> DataFrame:
    """One row per id; rows without an id name no record."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def clean_agent():
    return F.lower(trim_all(F.col("agent")))


def tool_stats(mcp: DataFrame) -> DataFrame:
    """(tool, n, n_errors, avg_ms, max_ms): calls, errors and measured latencies per tool; a redelivered event counts once."""
    e = _once(mcp.select("event_id", "event", "tool", "ms"), "event_id").where("tool is not null")
    ms = F.when(F.col("ms").isNotNull() & ~F.isnan("ms") & (F.col("ms") >= 0), F.col("ms"))
    return e.groupBy("tool").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("event") == "tool_error").cast("int")).alias("n_errors"),
        js_round(F.avg(ms)).cast("long").alias("avg_ms"), F.max(ms).alias("max_ms"),
    )


def agent_stats(mcp: DataFrame) -> DataFrame:
    """(agent, n, n_tools, n_versions, first_ts, last_ts) per agent, 'unknown' where it is null."""
    e = _once(mcp.select("event_id", "ts", "tool", "agent", "agent_version"), "event_id")
    return e.groupBy(F.coalesce(clean_agent(), F.lit("unknown")).alias("agent")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("tool").alias("n_tools"), F.count_distinct("agent_version").alias("n_versions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def trajectory(lease: DataFrame) -> DataFrame:
    """(agent, n_samples, avg_density, max_density, n_bursts): densities of degraded and stale leases; a burst has 0.6 or more."""
    e = _once(lease.select("lease_id", "event", "agent", "density"), "lease_id").where("event in ('degraded', 'stale')")
    d = F.when(~F.isnan("density") & (F.col("density") > 0), F.col("density"))
    return e.groupBy(F.coalesce(clean_agent(), F.lit("unknown")).alias("agent")).agg(
        F.count(d).alias("n_samples"), F.round(F.avg(d), 12).alias("avg_density"), F.max(d).alias("max_density"), F.sum(F.coalesce((d >= 0.6).cast("int"), F.lit(0))).alias("n_bursts")
    )


def _timed(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return _once(df.select(key, "ts", "agent", *columns), key).withColumn("agent", clean_agent()).where("agent is not null and ts is not null")


def recovery(mcp: DataFrame, lease: DataFrame) -> DataFrame:
    """(lease_id, agent, ts, recovered_at, recovery_ms): for each stale lease the agent's next orient call, strictly later."""
    stale = _timed(lease, "lease_id", "event").where("event = 'stale'").select("lease_id", "agent", "ts")
    orient = _timed(mcp, "event_id", "event", "tool").where("tool = 'orient' and event = 'tool_call'").select("agent", "ts")
    r = as_of_forward(stale, orient, "agent", "ts", "recovered_at")
    return r.withColumn("recovery_ms", ((F.unix_micros("recovered_at") - F.unix_micros("ts")) / 1000).cast("double"))


def stability(lease: DataFrame) -> DataFrame:
    """(lease_id, agent, ts, degraded_at): for each reset the agent's next degraded or stale lease."""
    e = _timed(lease, "lease_id", "event")
    return as_of_forward(e.where("event = 'orient_reset'").select("lease_id", "agent", "ts"), e.where("event in ('degraded', 'stale')").select("agent", "ts"), "agent", "ts", "degraded_at")


def stale_episodes(mcp: DataFrame, lease: DataFrame) -> DataFrame:
    """(agent, episode, start_ts, depth, calls_before_orient): an agent's stale spans, each ended by its next orient call.

    An episode is what lies between two orient calls; it begins with its first stale lease, its depth is the greatest
    seen, and the tool calls from there on count. Events at the same time come in the order lease, call, orient.
    """
    a = _timed(lease, "lease_id", "event", "depth", "to_depth").where("event in ('stale', 'depth_escalate')")
    a = a.select("agent", "ts", F.lit(0).alias("kind"), F.col("lease_id").alias("id"), F.coalesce("to_depth", "depth", F.lit(1)).alias("depth"))
    b = _timed(mcp, "event_id", "event", "tool").where("tool is not null")
    b = b.select("agent", "ts", F.when(F.col("tool") == "orient", 2).otherwise(1).alias("kind"), F.col("event_id").alias("id"), F.lit(None).cast("int").alias("depth"))
    e = running_count(a.unionByName(b), ["agent"], "ts", ["kind", "id"], F.col("kind") == 2, "n_orient")
    # an orient call ends the episode before it
    e = e.withColumn("episode", F.col("n_orient") - (F.col("kind") == 2).cast("int"))
    at = F.struct("ts", "kind", "id")
    start = e.where("kind = 0").groupBy("agent", "episode").agg(F.min(at).alias("start"), F.max("depth").alias("depth"))
    calls = e.where("kind = 1").join(start.select("agent", "episode", "start"), ["agent", "episode"]).where(at > F.col("start"))
    n = calls.groupBy("agent", "episode").agg(F.count(F.lit(1)).alias("n"))
    return start.join(n, ["agent", "episode"], "left").select("agent", "episode", F.col("start.ts").alias("start_ts"), "depth", F.coalesce("n", F.lit(0)).alias("calls_before_orient"))


# The weight of each tool; any other tool weighs 1.
TOOL_WEIGHTS = {
    "orient": 0, "analyze_codebase": 0,
    "search_code": 1, "search_specs": 1, "search_unified": 1, "list_spec_domains": 1, "list_decisions": 1, "record_decision": 1, "get_env_vars": 1, "get_external_packages": 1,
    "get_spec": 2, "get_signatures": 2, "get_function_body": 2, "get_function_skeleton": 2, "get_mapping": 2, "get_test_coverage": 2, "get_route_inventory": 2,
    "get_schema_inventory": 2, "get_ui_components": 2, "get_middleware_inventory": 2,
    "get_architecture_overview": 3, "get_call_graph": 3, "get_file_dependencies": 3, "get_critical_hubs": 3, "get_god_functions": 3, "get_leaf_functions": 3,
    "get_refactor_report": 3, "get_duplicate_report": 3, "check_spec_drift": 3, "detect_changes": 3, "audit_spec_coverage": 3, "get_decisions": 3, "get_minimal_context": 3,
    "get_subgraph": 5, "analyze_impact": 5, "get_cluster": 4, "generate_change_proposal": 5, "annotate_story": 5, "generate_tests": 4, "get_low_risk_refactor_candidates": 4,
    "trace_execution_path": 8,
}
# Thresholds of load, age in minutes and density; the window of modules.
LOAD, AGE, DENSITY = (30, 60, 85, 110), (15, 30, 45, 60), (0.15, 0.30, 0.60)
WINDOW, SWITCH_LOAD, DENSITY_LOAD, BURST_LOAD, BURST_WEIGHT = 15, 5, 15, 20, 8
SWITCH_QUIET_S, DENSITY_QUIET_S, VERSION_CHECK_S = 5, 60, 30


def module_density(window: list[str | None]) -> float:
    """Changes between consecutive known modules as a share of the window's full length."""
    known = [m for m in window if m is not None]
    return sum(a != b for a, b in zip(known, known[1:])) / WINDOW


def module_oscillation(window: list[str | None]) -> float:
    """Share of known modules that equal the one two before."""
    known = [m for m in window if m is not None]
    return sum(a == b for a, b in zip(known, known[2:])) / (len(known) - 2) if len(known) > 2 else 0.0


class Lease:
    """How fresh a session's picture of the code is: fresh, degraded, then stale in three depths, until it orients anew."""

    def __init__(self, now: float, version: str | None = None):
        self.reset(now, version)

    def reset(self, now: float, version: str | None = None) -> None:
        self.since, self.version, self.checked = now, version, now
        self.state, self.depth, self.load = "fresh", 0, 0.0
        self.window: list[str | None] = []
        self.module, self.switched, self.penalised = None, float("-inf"), float("-inf")
        self.density = self.oscillation = 0.0

    def _depth(self, age: float) -> int:
        for d in (3, 2):
            if self.load >= LOAD[d] or age >= AGE[d]:
                return d
        return 1

    def see(self, tool: str | None, module: str | None, now: float, version: str | None = None) -> tuple | None:
        """Take one call in; gives (event, trigger, depth before, depth after) where the state changes."""
        if tool == "orient":
            before = None if self.state == "fresh" else ("orient_reset", self.state, self.depth, 0)
            self.reset(now, version)
            return before
        age, weight = (now - self.since) / 60, TOOL_WEIGHTS.get(tool, 1)
        self.window = [*self.window, module][-WINDOW:]
        self.density, self.oscillation = module_density(self.window), module_oscillation(self.window)
        if self.state == "stale":
            before = self.depth
            burst = before < 3 and (weight >= BURST_WEIGHT or self.density >= DENSITY[2])
            self.depth = 3 if burst else max(before, self._depth(age))
            return ("depth_escalate", "burst" if burst else None, before, self.depth) if self.depth > before else None
        self.load += weight
        if module is not None:
            if self.module is not None and module != self.module and now - self.switched > SWITCH_QUIET_S:
                self.load += SWITCH_LOAD
                self.switched = now
            self.module = module
        if self.density >= DENSITY[1] and now - self.penalised > DENSITY_QUIET_S:
            self.load += BURST_LOAD if self.density >= DENSITY[2] else DENSITY_LOAD
            self.penalised = now
        if now - self.checked > VERSION_CHECK_S:
            self.checked = now
            if version and self.version and version != self.version:
                self.state, self.depth = "stale", self._depth(age)
                return "stale", "git", 0, self.depth
        for level, name in ((1, "stale"), (0, "degraded")):
            if name == "degraded" and self.state != "fresh":
                break
            why = "density" if self.density >= DENSITY[level] else "load" if self.load >= LOAD[level] else "time" if age >= AGE[level] else None
            if why:
                self.state, self.depth = name, self._depth(age) if name == "stale" else 0
                return name, why, 0, self.depth
        return None


LEASE_STATES = "agent string, event_id long, ts timestamp, tool string, state string, depth int, load double, density double, oscillation double, age_min long, event string, trigger string"


def lease_states(mcp: DataFrame, module: str | None = None) -> DataFrame:
    """(agent, event_id, ts, tool, state, depth, load, density, oscillation, age_min, event, trigger) after every call.

    An orient call starts the state anew, so the calls between two of them are worked on by themselves, whatever the
    agent's share of all events. Before its first orient call an agent's state starts with its first event.
    """
    columns = ["tool"] + ([module] if module else [])
    e = _timed(mcp, "event_id", *columns)
    e = e.withColumn("module", F.col(module) if module else F.lit(None).cast("string"))
    e = running_count(e, ["agent"], "ts", ["event_id"], F.col("tool") == "orient", "span")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lease, at = None, None
        for b in batches:
            out = []
            for agent, span, i, ts, tool, mod in zip(b.agent, b.span, b.event_id, b.ts, b.tool, b.module):
                now = ts.timestamp()
                if (agent, span) != at:
                    at, lease = (agent, span), Lease(now)
                got = lease.see(tool, mod, now) or (None, None, 0, 0)
                out.append((agent, i, ts, tool, lease.state, lease.depth, lease.load, lease.density, lease.oscillation, int((now - lease.since) // 60), got[0], got[1]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEASE_STATES.split(", ")])

    return e.repartition("agent", "span").sortWithinPartitions("agent", "span", "ts", "event_id").select("agent", "span", "event_id", "ts", "tool", "module").mapInPandas(run, LEASE_STATES)


def cache_stats(lookups: DataFrame, key: str) -> DataFrame:
    """(key, hits, total, hit_rate) of look-ups (key, hit boolean), the rate in percent rounded half up."""
    n = lookups.groupBy(key).agg(F.sum(F.col("hit").cast("int")).alias("hits"), F.count(F.lit(1)).alias("total"))
    return n.withColumn("hit_rate", js_round(100.0 * F.col("hits") / F.col("total")).cast("long"))
