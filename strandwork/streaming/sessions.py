"""Sessions and leases as stateful operators of a stream, with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandwork.operators.events import Lease
from strandwork.operators.sessions import GAP_US, SessionTimers

SESSIONS = "key string, start_us long, end_us long, counts array<long>"


class SessionProcessor(StatefulProcessor):
    """One open session per key in state; its timer stands at the last event plus the gap and emits it on expiry."""

    def __init__(self, width: int, gap_us: int):
        self.width, self.gap = width, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_us long, end_us long, counts array<long>")

    def _load(self) -> SessionTimers:
        t = SessionTimers(self.gap, self.width)
        if self.open.exists():
            t.start, t.end, counts = self.open.get()
            t.counts = [int(c) for c in counts]
        return t

    def _save(self, t: SessionTimers) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if t.start is None:
            self.open.clear()
        else:
            self.open.update((t.start, t.end, t.counts))
            self.handle.registerTimer((t.end + self.gap) // 1000 + 1)

    def _rows(self, key, done: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *d) for d in done], columns=["key", "start_us", "end_us", "counts"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t = self._load()
        every = pd.concat(list(rows)).sort_values("us")
        done = [d for d in (t.at(int(us), int(k)) for us, k in zip(every.us, every.kind)) if d]
        self._save(t)
        if done:
            yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t = self._load()
        done = t.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._save(t)
        if done:
            yield self._rows(key, [done])

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, width: int = 1, gap_us: int = GAP_US, delay: str = "10 minutes") -> DataFrame:
    """(key, start_us, end_us, counts) from a stream of (key, ts, kind); rows later than the delay are dropped.

    The session of a key is emitted once the watermark has passed its last event by the gap, or when a later event of
    the key shows that the gap was exceeded. Needs the RocksDB state store.
    """
    rows = events.where("key is not null and ts is not null").withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).select("key", "ts", "us", F.coalesce("kind", F.lit(-1)).alias("kind"))
    return rows.groupBy("key").transformWithStateInPandas(SessionProcessor(width, gap_us), SESSIONS, outputMode="append", timeMode="eventTime")


class LeaseProcessor(StatefulProcessor):
    """The lease of each session in state; emits its changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lease", "pickled binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import pickle

        every = pd.concat(list(rows)).sort_values("ts")
        lease = pickle.loads(self.state.get()[0]) if self.state.exists() else None  # noqa: S301 - our own state
        out = []
        for ts, tool, module in zip(every.ts, every.tool, every.module):
            now = ts.timestamp()
            lease = lease or Lease(now)
            got = lease.see(tool, module, now)
            if got:
                out.append((key[0], ts, tool, got[0], got[1], int(got[3]), float(lease.load)))
        self.state.update((pickle.dumps(lease),))
        if out:
            yield pd.DataFrame(out, columns=["session", "ts", "tool", "event", "trigger", "depth", "load"])

    def close(self) -> None:
        pass


def stream_leases(calls: DataFrame) -> DataFrame:
    """(session, ts, tool, event, trigger, depth, load): state changes from a stream of (session, ts, tool, module)."""
    return calls.where("session is not null and ts is not null").groupBy("session").transformWithStateInPandas(
        LeaseProcessor(), "session string, ts timestamp, tool string, event string, trigger string, depth int, load double", outputMode="append", timeMode="none"
    )


def stream_tool_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, tool, n, max_ms) per tumbling window of a stream of mcp events, each event_id once."""
    once = events.where("ts is not null").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window).alias("w"), "tool").agg(F.count(F.lit(1)).alias("n"), F.max("ms").alias("max_ms")).select(F.col("w.start").alias("start"), "tool", "n", "max_ms")
