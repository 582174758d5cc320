"""Sessions of activity, cut at long silences by keyed timers.

An event opens its key's session or extends it, and sets the session's timer to its own time plus the gap. A timer that
expires before the key's next event closes the session and emits its start, end and counts. ``SessionTimers`` is that
machine; ``streaming/sessions.py`` runs it as a stateful stream operator with event-time timers, this module replays
stored events through it in order.

In a replay a key's events are cut into slices of many gaps, so a key with a third of all events is spread over as many
tasks as it has slices. Each slice runs its own timers up to the slice's end: a session whose timer expired by then, and
that began more than a gap after the slice's start, is final. Only sessions within a gap of a slice's ends stay open;
they are replayed as events of some length through the same timers over groups of slices, and what is open there over
the whole key, so that no task ever holds all slices of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.util import cut, trim_all

GAP_US = 30 * 60 * 1_000_000
#: Length of a slice, twelve gaps, and number of slices in a group.
SLICE_US = 6 * 60 * 60 * 1_000_000
GROUP = 64

_PARTS = "key string, piece long, start_us long, end_us long, counts array<long>, is_open boolean"


class SessionTimers:
    """One key's open session. at(ts) and expire(now) return the session that ended, if one did."""

    __slots__ = ("counts", "end", "gap", "start")

    def __init__(self, gap: int, width: int):
        self.gap, self.start, self.end, self.counts = gap, None, 0, [0] * width

    def expire(self, now: int):
        """Run the timer up to now: a session silent for more than the gap is closed."""
        if self.start is None or now <= self.end + self.gap:
            return None
        return self.close()

    def close(self):
        done = (self.start, self.end, self.counts)
        self.start, self.end, self.counts = None, 0, [0] * len(self.counts)
        return done

    def take(self, start: int, end: int, counts):
        """Take in a session that another machine left open; they come in order of start."""
        done = self.expire(start)
        self.end = end if self.start is None else max(self.end, end)
        self.start = start if self.start is None else self.start
        self.counts = [a + int(b) for a, b in zip(self.counts, counts)]
        return done

    def at(self, ts: int, kind: int):
        """Take an event in. One that comes late extends its session backwards, or is a session by itself."""
        if self.start is not None and ts < self.start - self.gap:
            return ts, ts, [int(k == kind) for k in range(len(self.counts))]
        done = self.expire(ts)
        self.end = ts if self.start is None else max(self.end, ts)
        self.start = ts if self.start is None else min(self.start, ts)
        if kind >= 0:
            self.counts[kind] += 1
        return done


def _replay(gap: int, width: int, span: int | None):
    """Run rows (key, piece, us, kind) or open sessions (key, piece, start_us, end_us, counts), in order, through the
    timers of their piece, which covers span microseconds (all time if None)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now: tuple = (None, None)
        timers = None

        def emit(done, is_open):
            early = span is not None and done[0] - now[1] * span <= gap
            out.append((*now, done[0], done[1], done[2], early or is_open))

        def finish():
            # the timer runs on to the end of the piece; what is still open then may go on in the next one
            done = None if span is None else timers.expire((now[1] + 1) * span)
            if done is not None:
                emit(done, False)
            elif timers.start is not None:
                emit(timers.close(), span is not None)

        for b in batches:
            events = "us" in b
            rows = zip(b.key.tolist(), b.piece.tolist(), b.us.tolist(), b.kind.tolist()) if events else zip(
                b.key.tolist(), b.piece.tolist(), b.start_us.tolist(), zip(b.end_us.tolist(), b.counts)
            )
            for key, piece, us, what in rows:
                if (key, piece) != now:
                    if timers is not None:
                        finish()
                    now, timers = (key, piece), SessionTimers(gap, width)
                done = timers.at(us, what) if events else timers.take(us, *what)
                if done is not None:
                    emit(done, False)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["key", "piece", "start_us", "end_us", "counts", "is_open"])
                out = []
        if timers is not None:
            finish()
        if out:
            yield pd.DataFrame(out, columns=["key", "piece", "start_us", "end_us", "counts", "is_open"])

    return run


def sessionize(events: DataFrame, key: Column, ts: Column, kind: Column, width: int, gap_us: int = GAP_US, slice_us: int = SLICE_US) -> DataFrame:
    """(key, start_us, end_us, counts): the sessions of each key; counts[k] are the events whose kind is k.

    events must hold one row per record. kind is an int in 0..width-1, or negative for an event that only keeps the
    session open. A silence of exactly gap_us does not end a session. Rows with a null key or ts are left out; events
    at the same time belong to one session in any order; an empty table gives no sessions.
    """
    final, rows = session_pieces(events, key, ts, kind, width, gap_us, slice_us)
    last = rows.withColumn("piece", F.lit(0).cast("long")).repartition("key").sortWithinPartitions("key", "piece", "start_us")
    out = last.mapInPandas(_replay(gap_us, width, None), _PARTS)
    for f in final:
        out = out.unionByName(f)
    return out.select("key", "start_us", "end_us", "counts")


def session_pieces(events: DataFrame, key: Column, ts: Column, kind: Column, width: int, gap_us: int, slice_us: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables of sessions that a timer closed within a slice or a group of slices, sessions still open), see sessionize."""
    rows = events.select(key.alias("key"), F.unix_micros(ts.cast("timestamp")).alias("us"), F.coalesce(kind.cast("int"), F.lit(-1)).alias("kind"))
    rows = rows.where("key is not null and us is not null").withColumn("piece", ((F.col("us") - F.pmod(F.col("us"), F.lit(slice_us))) / slice_us).cast("long"))
    order, span, final = "us", slice_us, []
    for _ in range(2):
        parts = cut(rows.repartition("key", "piece").sortWithinPartitions("key", "piece", order).mapInPandas(_replay(gap_us, width, span), _PARTS))
        final.append(parts.where("not is_open"))
        rows = parts.where("is_open").withColumn("piece", F.floor(F.col("piece") / GROUP)).drop("is_open")
        order, span = "start_us", span * GROUP
    return final, rows


LEASE_EVENTS = ("degraded", "stale", "depth_escalate", "orient_reset")


def agent_records(mcp: DataFrame, lease: DataFrame) -> DataFrame:
    """(agent, ts, kind) of both logs, one row per record: kind 0 is a tool event, 1.. the lease events, last any other.

    agent is trimmed of white space and in lower case. Rows that share an id are one record, at its earliest ts; rows
    without an id, agent or ts are left out.
    """
    agent = F.lower(trim_all(F.col("agent"))).alias("agent")
    other = len(LEASE_EVENTS) + 1
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, LEASE_EVENTS)), F.col("event")), F.lit(0))
    m = mcp.select(F.col("event_id").alias("id"), agent, "ts", F.lit(0).alias("kind"))
    n = lease.select(F.col("lease_id").alias("id"), agent, "ts", F.when(kind > 0, kind).otherwise(other).cast("int").alias("kind"))
    both = m.withColumn("log", F.lit(0)).unionByName(n.withColumn("log", F.lit(1)))
    one = both.where("id is not null and agent is not null and ts is not null").groupBy("log", "id").agg(F.min(F.struct("ts", "agent", "kind")).alias("r"))
    return one.select("r.agent", "r.ts", "r.kind")


def agent_sessions(mcp: DataFrame, lease: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """(agent, start_us, end_us, duration_s, n_mcp, n_lease, n_degraded, n_stale, n_depth_escalate, n_orient_reset)."""
    k = len(LEASE_EVENTS)
    s = sessionize(agent_records(mcp, lease), F.col("agent"), F.col("ts"), F.col("kind"), k + 2, gap_us)
    each = [F.col("counts")[i + 1].alias(f"n_{e}") for i, e in enumerate(LEASE_EVENTS)]
    total = sum((F.col("counts")[i] for i in range(2, k + 2)), F.col("counts")[1])
    return s.select(
        F.col("key").alias("agent"), "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"),
        F.col("counts")[0].alias("n_mcp"), total.alias("n_lease"), *each,
    )
