import importlib.util
from datetime import datetime, timedelta

import pytest

from strandwork.operators.events import Lease
from strandwork.streaming.sessions import stream_leases, stream_sessions, stream_tool_counts

T0 = datetime(2025, 1, 6)
needs_state = pytest.mark.skipif(importlib.util.find_spec("google") is None or importlib.util.find_spec("google.protobuf") is None, reason="Python state needs protobuf")


def run(spark, tmp_path, rows, schema, build, keep):
    src = tmp_path / "in"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(src))
        del i
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = build(s).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*keep).collect())


@needs_state
def test_stream_sessions(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [[("a", at(0), 0), ("a", at(30), 0), ("b", at(5), 0)], [("a", at(61), 0), ("a", at(70), 0)], [("z", at(500), 0)], [("z", at(501), 0)]]
    got = run(spark, tmp_path, rows, "key string, ts timestamp, kind int", stream_sessions, ["key", "start_us", "end_us", "counts"])
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6)
    us = lambda m: base + m * 60_000_000
    assert got[:3] == [("a", us(0), us(30), [2]), ("a", us(61), us(70), [2]), ("b", us(5), us(5), [1])]


@needs_state
def test_stream_leases(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [[("s", at(0), "orient", None), ("s", at(1), "get_spec", None)], [("s", at(16), "get_spec", None), ("s", at(31), "get_spec", None)], [("s", at(32), "trace_execution_path", None), ("s", at(33), "orient", None)]]
    got = run(spark, tmp_path, rows, "session string, ts timestamp, tool string, module string", stream_leases, ["ts", "event", "trigger", "depth"])
    assert got == [(at(16), "degraded", "time", 0), (at(31), "stale", "time", 1), (at(32), "depth_escalate", "burst", 3), (at(33), "orient_reset", "stale", 0)]


def test_stream_tool_counts(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [[(1, at(1), "t", 5.0), (1, at(1), "t", 5.0), (2, at(50), "t", 9.0)], [(3, at(70), "u", 1.0)], [(4, at(400), "t", 1.0)], [(5, at(401), "t", 1.0)]]
    got = run(spark, tmp_path, rows, "event_id long, ts timestamp, tool string, ms double", stream_tool_counts, ["start", "tool", "n", "max_ms"])
    assert got[:2] == [(at(0), "t", 2, 9.0), (at(60), "u", 1, 1.0)]


def test_lease_machine():
    x = Lease(0.0)
    assert all(x.see("get_subgraph", None, i) is None for i in range(5))
    assert x.see("get_subgraph", None, 5)[:2] == ("degraded", "load")
    for i in range(5):
        x.see("get_subgraph", None, 6 + i)
    assert x.see("get_subgraph", None, 20)[:2] == ("stale", "load")
    assert x.load == 60 and x.see("get_subgraph", None, 21) is None and x.load == 60
    assert x.see("trace_execution_path", None, 22) == ("depth_escalate", "burst", 1, 3)
    assert x.see("orient", None, 30) == ("orient_reset", "stale", 3, 0) and x.state == "fresh"
    y = Lease(0.0)
    out = [y.see("search_code", m, 10.0 * i) for i, m in enumerate("ABABAB")]
    assert out[3][:2] == ("degraded", "density") and out[5][:2] == ("stale", "density") and y.oscillation == 1.0
    v = Lease(0.0, "v1")
    assert v.see("get_spec", None, 31, "v2") == ("stale", "git", 0, 1)
