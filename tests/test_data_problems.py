import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.operators import quantiles as q
from strandwork.operators.references import broken_reference_counts, broken_references
from strandwork.operators.sessions import SessionTimers, agent_sessions, session_pieces, sessionize
from strandwork.operators.tree_aggregation import distinct_counts, distinct_in_chunks, fan_in_report, row_counts, wrong_fan_in

T0 = datetime(2025, 1, 6)
EDGE = "edge_id long, caller_id string, callee_id string, callee_file string, observed_at timestamp, n int, chunk string, key string"
NODE = "id string, fan_in int, is_external int, indexed_at timestamp, deleted_at timestamp, n int, chunk string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- p2 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("chunks", "fan_in"), [(1, 2), (16, 2), (64, 8)])
def test_distinct_counts_with_a_hub(spark, chunks, fan_in):
    r = random.Random(1)
    data = [("hub" if r.random() < 0.5 else r.choice("abcde"), r.choice([None, *map(str, range(300))])) for _ in range(4000)] + [(None, "x"), ("only-null", None)]
    want = defaultdict(set)
    for k, v in data:
        if k is not None:
            want[k] |= {v} - {None}
    df = spark.createDataFrame([(k, v, "z", 1) for k, v in data], "key string, v string, chunk string, n int").repartition(7)
    assert rows(distinct_counts(df, "key", "v", "n", chunks, fan_in)) == sorted((k, len(v)) for k, v in want.items())
    total = defaultdict(int)
    for k, _ in data:
        total[k] += 1
    assert {(k, n) for k, n in row_counts(df, "key", "n", chunks, fan_in).collect()} == set(total.items())


def test_one_pair_repeated(spark):
    # the repeats of a pair go before anything is shuffled: one row is left of each chunk
    df = spark.range(1_000_000, numPartitions=4).select(F.lit("hub").alias("key"), F.when(F.col("id") % 500_000 == 0, F.col("id")).otherwise(7).cast("string").alias("v"))
    assert distinct_in_chunks(df, 50_000).count() <= 3 * (1_000_000 // 50_000 + 4)
    assert rows(distinct_counts(df, "key", "v")) == [("hub", 3)]
    assert distinct_in_chunks(df.limit(0)).collect() == []


def test_fan_in(spark):
    nodes = spark.createDataFrame([("a", 2, 0, None, None, 9, "c"), ("a", 2, 0, None, None, 9, "c"), ("b", None, 0, None, None, 9, "c"), ("c", 0, 0, None, None, 9, "c"), ("d", 5, 0, None, None, 9, "c"), ("x", 7, 1, None, None, 9, "c")], NODE)
    edges = spark.createDataFrame([(1, "p", "a", None, None, 1, "", ""), (1, "p", "a", None, None, 1, "", ""), (2, "q", "a", None, None, 1, "", ""), (3, None, "d", None, None, 1, "", "")], EDGE)
    assert rows(wrong_fan_in(nodes, edges)) == [("b",), ("d",)]
    assert {(r["id"], r["n_callers"]) for r in fan_in_report(nodes, edges).collect()} == {("a", 2), ("b", 0), ("c", 0), ("d", 0), ("x", 0)}
    assert rows(wrong_fan_in(nodes.limit(0), edges)) == []
    assert {r["id"] for r in wrong_fan_in(nodes, edges.limit(0)).collect()} == {"a", "b", "d"}


# -- p3 ------------------------------------------------------------------------------------------------------------


def off_rank(values, p, got):
    """How far the answer's ranks lie from the rank asked for."""
    v = np.sort(values)
    r = max(1, math.ceil(p * len(v) - 1e-9))
    low, high = np.searchsorted(v, got, "left") + 1, np.searchsorted(v, got, "right")
    return max(low - r, r - high, 0)


@pytest.mark.parametrize("seed", range(6))
def test_summaries_keep_their_error(seed):
    r = np.random.default_rng(seed)
    parts = [r.choice([r.lognormal(3, 2, n), r.integers(0, 5, n).astype(float), np.sort(r.normal(size=n))][seed % 3], n) for n in r.integers(1, 4000, 9)]
    everything = np.concatenate(parts)
    eps = 0.01
    s = [q.compress(q.summarise(p), eps) for p in parts]
    for x, p in zip(s, parts):
        assert q.rank_error(x) <= eps * len(p)
    m = q.compress(q._pairwise(s), eps)
    assert m[0] == len(everything)
    assert q.rank_error(m) <= eps * len(everything) + 1
    assert len(m[1]) < 400
    for p in (0, 0.01, 0.5, 0.9, 0.99, 1):
        assert off_rank(everything, p, q.answer(m, p)) <= q.rank_error(m)


def test_percentiles_of_tools(spark):
    r = random.Random(3)
    data = []
    for i in range(6000):
        tool = r.choice([None, "hot", "hot", "hot", "rare"])
        ms = r.choice([None, float("nan"), -1.0, *[r.lognormvariate(4, 1)] * 9])
        ts = None if r.random() < 0.02 else T0 + timedelta(hours=r.randrange(72))
        data += [(i, ts, tool, ms, "c", 3)] * r.choice([1, 1, 2])
    df = spark.createDataFrame(data, "event_id long, ts timestamp, tool string, ms double, chunk string, n int").repartition(5)
    want = defaultdict(list)
    for i, ts, tool, ms, *_ in dict((d[0], d) for d in data).values():
        if None not in (ts, tool, ms) and ms >= 0:
            want[tool, ts.strftime("%Y-%m-%d")].append(ms)
            want[tool, "all"].append(ms)
    got = q.tool_percentiles(df).collect()
    assert {(g["tool"], g["ev_day"]): g["n"] for g in got} == {k: len(v) for k, v in want.items()}
    for g in got:
        values = np.array(want[g["tool"], g["ev_day"]])
        assert g["rank_error"] <= 0.01
        for name, p in q.POINTS.items():
            assert off_rank(values, p, g[name]) <= 0.01 * len(values) + 1e-9
    assert q.tool_percentiles(df.limit(0)).collect() == []
    assert q.slow_days(df.limit(0)).collect() == []


def test_slow_day(spark):
    data = [(i, T0 + timedelta(days=d), "t", 10.0 * (5 if d == 2 else 1)) for d in range(9) for i in range(d * 100, d * 100 + (19 if d == 3 else 30))]
    data += [(5000 + i, T0 + timedelta(days=20), "t", 900.0) for i in range(19)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, tool string, ms double")
    assert rows(q.slow_days(df)) == [("t", "2025-01-08")]


# -- p5 ------------------------------------------------------------------------------------------------------------

MCP = "event_id long, ts timestamp, agent string, key string, piece int"
LEASE = "lease_id long, ts timestamp, event string, agent string, kind int"


def test_timers():
    t = SessionTimers(10, 1)
    assert [t.at(x, 0) for x in (0, 10, 20)] == [None] * 3
    assert t.expire(30) is None
    assert t.expire(31) == (0, 20, [3])
    assert t.expire(99) is None
    assert t.at(50, 0) is None and t.at(70, 0) == (50, 50, [1]) and t.close() == (70, 70, [1])


def test_sessions_against_a_plain_walk(spark):
    r = random.Random(5)
    mcp, lease = [], []
    for i in range(900):
        agent = r.choice([" Hot", "hot\t", "HOT ", "cold", "", None])
        ts = None if r.random() < 0.02 else T0 + timedelta(minutes=r.choice([r.randrange(4000), 30 * r.randrange(40)]))
        mcp += [(i, ts, agent, "k", 1)] * r.choice([1, 2])
        lease.append((i, ts and ts + timedelta(minutes=15), r.choice(["stale", "degraded", "orient_reset", "other", None]), agent, 4))
    by = defaultdict(set)
    for i, ts, a, *_ in mcp:
        if a is not None and ts is not None:
            by[a.strip().lower()].add((ts, "m", i, None))
    for i, ts, e, a, _ in lease:
        if a is not None and ts is not None:
            by[a.strip().lower()].add((ts, "l", i, e))
    want = []
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    for a, s in by.items():
        run = []
        for x in sorted(s, key=lambda x: x[0]):
            if run and x[0] - run[-1][0] > timedelta(minutes=30):
                want.append((a, run))
                run = []
            run.append(x)
        want.append((a, run))
    expect = sorted((a, us(s[0][0]), us(s[-1][0]), sum(x[1] == "m" for x in s), sum(x[1] == "l" for x in s), sum(x[3] == "stale" for x in s)) for a, s in want)
    m, n = spark.createDataFrame(mcp, MCP).repartition(6), spark.createDataFrame(lease, LEASE).repartition(3)
    got = agent_sessions(m, n)
    assert rows(got.select("agent", "start_us", "end_us", "n_mcp", "n_lease", "n_stale")) == expect
    assert all(x["duration_s"] == (x["end_us"] - x["start_us"]) / 1e6 for x in got.collect())
    assert agent_sessions(m.limit(0), n.limit(0)).collect() == []


def test_sessions_over_slices_and_groups(spark, monkeypatch):
    from strandwork.operators import sessions

    monkeypatch.setattr(sessions, "GROUP", 3)
    r = random.Random(9)
    gap = 10
    events = [(r.choice("ab"), us - 2000) for us in sorted(r.sample(range(6000), 900))] + [("long", us) for us in range(-300, 900, 10)] + [("edge", 120), ("edge", 130), ("edge", 141), (None, 5)]
    want = []
    for k in ("a", "b", "long", "edge"):
        run = []
        for us in sorted(u for key, u in events if key == k):
            if run and us - run[-1] > gap:
                want.append((k, run[0], run[-1], [len(run)]))
                run = []
            run.append(us)
        want.append((k, run[0], run[-1], [len(run)]))
    df = spark.createDataFrame(events, "k string, us long").withColumn("ts", F.timestamp_micros("us")).repartition(5)
    args = (df, F.col("k"), F.col("ts"), F.lit(0), 1, gap, 12 * gap)
    assert rows(sessionize(*args)) == sorted(want)
    # most sessions are closed by a timer within their slice, and some within a group of slices
    final, rest = session_pieces(*args)
    assert final[0].count() > len(want) / 2 and final[1].count() > 0 and rest.count() < final[0].count()


# -- p7 ------------------------------------------------------------------------------------------------------------


def test_broken_references_against_lookup(spark):
    r = random.Random(8)
    day = lambda: T0 + timedelta(days=r.randrange(10))
    nodes = {f"n{i}": (day() if r.random() < 0.9 else None, day() if r.random() < 0.3 else None) for i in range(40)}
    files = {f"f{i}": (day(), day() if r.random() < 0.3 else None) for i in range(15)}
    pick = lambda k, n: None if r.random() < 0.05 else "n0" if k == "n" and r.random() < 0.4 else f"{k}{r.randrange(n)}"
    edges = [(i, pick("n", 50), pick("n", 50), pick("f", 20), day() if r.random() < 0.97 else None, 1, "c", "k") for i in range(700)]
    want = set()
    for i, a, b, f, at, *_ in edges:
        for field, key, table in (("caller_id", a, nodes), ("callee_id", b, nodes), ("callee_file", f, files)):
            if key is None:
                continue
            born, gone = table.get(key, (None, None))
            if key not in table:
                want.add((i, field, "missing"))
            elif at and born and born > at:
                want.add((i, field, "late"))
            elif at and gone and gone <= at:
                want.add((i, field, "deleted"))
    e = spark.createDataFrame(edges + edges[:50], EDGE).repartition(5)
    n = spark.createDataFrame([(k, 1, 0, b, g, 5, "x") for k, (b, g) in nodes.items()], NODE)
    f = spark.createDataFrame([(k, b, g) for k, (b, g) in files.items()], "file_path string, first_seen_at timestamp, removed_at timestamp")
    got = broken_references(e, {"nodes": n, "file_hashes": f})
    assert rows(got.select("edge_id", "ref_field", "reason")) == sorted(want)
    counts = broken_reference_counts(e, {"nodes": n, "file_hashes": f}).collect()
    assert sum(c["n"] for c in counts) == len(want)
    assert broken_references(e.limit(0), {"nodes": n, "file_hashes": f}).collect() == []
    none = broken_references(e, {"nodes": n.limit(0), "file_hashes": f.limit(0)}).collect()
    assert len(none) == sum(x is not None for row in edges for x in row[1:4]) and {x["reason"] for x in none} == {"missing"}
