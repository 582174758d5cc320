"""Percentiles of very large numeric columns with a bounded rank error.

A summary is a sorted list of tuples (value, upto, before): at least ``upto`` of the n values are at or below the value
and at most ``before`` are below it, which is the value's rank interval with ties taken together. Every partition sums
up its own values exactly and compresses to the permitted uncertainty; summaries are merged in rounds of ``fan_in`` and
compressed after each round, each round being allowed a little more of eps. A summary carries n and err, the bound on
the rank error of any answer, read off its own tuples. Summaries of days, partitions or sites can be kept and merged
later without the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.util import cut, partitions

FAN_IN = 8
FIELDS = ["n", "err", "vals", "upto", "below"]
SUMMARY = "n long, err long, vals array<double>, upto array<long>, below array<long>"
#: Tuples a partition may hold of one group before it compresses.
HOLD = 60_000


def summarise(values: np.ndarray) -> tuple:
    """The exact summary of some values; equal values share one tuple."""
    vals, each = np.unique(values, return_counts=True)
    upto = np.cumsum(each)
    return int(each.sum()), vals, upto, upto - each


def merge(a: tuple, b: tuple) -> tuple:
    """Merge two summaries: the tuples of both, each with the rank interval it has in the union."""
    na, va, ua, ba = a
    nb, vb, ub, bb = b
    if na == 0 or nb == 0:
        return b if na == 0 else a

    def into(v, up, below, w, wup, wbelow, n):
        i = np.searchsorted(w, v, side="right")
        k = np.searchsorted(w, v, side="left")
        return up + np.where(i > 0, wup[np.maximum(i - 1, 0)], 0), below + np.where(k < len(w), wbelow[np.minimum(k, len(w) - 1)], n)

    u1, b1 = into(va, ua, ba, vb, ub, bb, nb)
    u2, b2 = into(vb, ub, bb, va, ua, ba, na)
    v, up, below = np.concatenate([va, vb]), np.concatenate([u1, u2]), np.concatenate([b1, b2])
    order = np.argsort(v, kind="stable")
    v, up, below = v[order], up[order], below[order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    return na + nb, v[first], np.maximum.reduceat(up, first), np.minimum.reduceat(below, first)


def rank_error(s: tuple) -> int:
    """No answer's rank is further off than this."""
    _, v, up, below = s
    return int(max(0, (below[1:] - up[:-1]).max(initial=0) + 1) // 2) if len(v) > 1 else 0


def compress(s: tuple, share: float) -> tuple:
    """Keep few tuples, both ends among them, so that the rank error does not exceed share * n or what it was."""
    n, v, up, below = s
    room = math.floor(2 * share * n) - 1
    if len(v) <= 2 or room < 1:
        return s
    keep, at, last = [0], 0, len(v) - 1
    while at < last:
        at = min(max(int(np.searchsorted(below, up[at] + room, side="right")) - 1, at + 1), last)
        keep.append(at)
    return n, v[keep], up[keep], below[keep]


def answer(s: tuple, p: float) -> float | None:
    """The kept value nearest in rank to ceil(p * n); the smallest of several."""
    n, v, up, below = s
    if n == 0:
        return None
    r = max(1, math.ceil(p * n - 1e-9))
    off = np.maximum(np.maximum(below + 1 - r, r - up), 0)
    return float(v[int(np.argmin(off))])


def _of(r) -> tuple:
    return r.n, np.asarray(r.vals, dtype=float), np.asarray(r.upto, dtype=np.int64), np.asarray(r.below, dtype=np.int64)


def _row(s: tuple) -> tuple:
    return s[0], rank_error(s), *s[1:]


def _pairwise(parts: list[tuple]) -> tuple:
    while len(parts) > 1:
        parts = [merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _keys(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def quantile_summaries(df: DataFrame, keys: list[str], value: str, eps: float = 0.005, chunks: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """(keys, n, err, vals, upto, below): one summary per group with err <= eps * n.

    df has one row per value. Null and NaN values and rows with a null key are left out; infinities are values.
    Partitions sum up what they hold of each group, so a group with a third of all rows is worked on by all of them. An
    empty table gives no summaries; columns besides keys and value are not read.
    """
    left = chunks or partitions(df.sparkSession)
    rounds = [left := -(-left // fan_in)]
    while left > 1:
        rounds.append(left := -(-left // fan_in))
    schema = _keys(df, keys)
    share = lambda i: eps * (i + 1) / (len(rounds) + 1)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        waiting: dict[tuple, list] = {}
        rows = 0

        def settle():
            for key, parts in waiting.items():
                s = summarise(np.concatenate(parts))
                s = merge(held[key], s) if key in held else s
                held[key] = compress(s, share(0) / 2) if len(s[1]) > HOLD else s
            waiting.clear()

        for b in batches:
            for key, part in b.groupby(keys, sort=False)[value]:
                waiting.setdefault(key, []).append(part.to_numpy(dtype=float))
            rows += len(b)
            if rows > 2_000_000:
                settle()
                rows = 0
        settle()
        if held:
            yield pd.DataFrame([(*key, *_row(compress(s, share(0)))) for key, s in held.items()], columns=[*keys, *FIELDS])

    def joiner(i: int):
        def up(part: pd.DataFrame) -> pd.DataFrame:
            s = compress(_pairwise([_of(r) for r in part.itertuples(index=False)]), share(i))
            first = part.iloc[0]
            return pd.DataFrame([(*[first[k] for k in keys], first["chunk"], *_row(s))], columns=[*keys, "chunk", *FIELDS])

        return up

    known = " and ".join(f"`{k}` is not null" for k in keys)
    clean = df.select(*keys, F.col(value).cast("double").alias(value)).where(f"{known} and `{value}` is not null and not isnan(`{value}`)")
    s = clean.mapInPandas(local, f"{schema}, {SUMMARY}").withColumn("chunk", F.pmod(F.spark_partition_id(), F.lit(chunks or partitions(df.sparkSession))))
    for i in range(len(rounds)):
        s = s.withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("int"))
        s = s.groupBy(*keys, "chunk").applyInPandas(joiner(i + 1), f"{schema}, chunk int, {SUMMARY}")
    return s.drop("chunk")


#: First groups of summaries that merge_summaries makes.
MERGE_CHUNKS = 64


def merge_summaries(df: DataFrame, keys: list[str], eps: float = 0.01, chunks: int = MERGE_CHUNKS, fan_in: int = 8) -> DataFrame:
    """Merge summaries by fewer keys, days to a whole, say; the errors add up, and err has the result's.

    In rounds: summaries are dealt into chunks by their other keys, merged and compressed, then ``fan_in`` chunks at a
    time, to a growing share of the permitted error, so that no task holds all summaries of a key.
    """

    def joiner(share: float):
        def up(part: pd.DataFrame) -> pd.DataFrame:
            s = compress(_pairwise([_of(r) for r in part.itertuples(index=False)]), share)
            first = part.iloc[0]
            return pd.DataFrame([(*[first[k] for k in keys], first["chunk"], *_row(s))], columns=[*keys, "chunk", *FIELDS])

        return up

    other = [c for c in df.columns if c not in FIELDS and c not in keys]
    spread = F.pmod(F.xxhash64(*other), F.lit(chunks)) if other else F.lit(0)
    s = df.select(*keys, spread.cast("int").alias("chunk"), *FIELDS)
    n, rounds = chunks, 1
    while n > 1:
        n, rounds = -(-n // fan_in), rounds + 1
    for i in range(rounds):
        if i:
            s = s.withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("int"))
        s = s.groupBy(*keys, "chunk").applyInPandas(joiner(eps / 2 + eps / 2 * (i + 1) / rounds), f"{_keys(df, keys)}, chunk int, {SUMMARY}")
    return s.drop("chunk")


def read_quantiles(df: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """(keys, n, rank_error, one column per point) from summaries; rank_error is the proven bound as a share of n."""
    schema = ", ".join([_keys(df, keys), "n long, rank_error double", *[f"`{c}` double" for c in points]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (*[getattr(r, k) for k in keys], r.n, r.err / max(r.n, 1), *[answer(_of(r), p) for p in points.values()])
                for r in b.itertuples(index=False)
            ]
            yield pd.DataFrame(rows, columns=[*keys, "n", "rank_error", *points])

    return df.select(*keys, *FIELDS).mapInPandas(run, schema)


POINTS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def measured(events: DataFrame) -> DataFrame:
    """(tool, ev_day, ms) of the measured values of mcp_events.

    Measured: tool, ts and ms not null, ms neither NaN nor negative. Rows that share an event_id count once; rows
    without an event_id name no record and are left out.
    """
    return (
        events.select("event_id", "ts", "tool", "ms")
        .where("event_id is not null and tool is not null and ts is not null and ms is not null and not isnan(ms) and ms >= 0")
        .dropDuplicates(["event_id"])
        .select("tool", F.date_format("ts", "yyyy-MM-dd").alias("ev_day"), "ms")
    )


def tool_percentiles(events: DataFrame, eps: float = 0.01) -> DataFrame:
    """(tool, ev_day, n, rank_error, p50, p90, p95, p99) for each tool and day, and with ev_day 'all' for all days.

    The rows are read once: the days' summaries are merged for the whole.
    """
    days = cut(quantile_summaries(measured(events), ["tool", "ev_day"], "ms", eps / 2))
    whole = merge_summaries(days, ["tool"], eps).withColumn("ev_day", F.lit("all"))
    return read_quantiles(days.unionByName(whole), ["tool", "ev_day"], POINTS)


def rank_check(events: DataFrame, eps: float = 0.01) -> DataFrame:
    """(tool, ev_day, n, p50_ok ...): whether each percentile's true rank, counted over all values, is within eps."""
    r = cut(tool_percentiles(events, eps))
    m = measured(events)
    m = m.unionByName(m.withColumn("ev_day", F.lit("all"))).join(r.drop("n", "rank_error"), ["tool", "ev_day"])
    n = F.count(F.lit(1))
    counts = [x for p in POINTS for x in (F.sum((F.col("ms") < F.col(p)).cast("int")).alias(f"{p}_below"), F.sum((F.col("ms") <= F.col(p)).cast("int")).alias(f"{p}_upto"))]
    c = m.groupBy("tool", "ev_day").agg(n.alias("n"), *counts)
    ok = [((F.col(f"{p}_below") <= (q + eps) * F.col("n")) & (F.col(f"{p}_upto") >= (q - eps) * F.col("n"))).alias(f"{p}_ok") for p, q in POINTS.items()]
    return c.select("tool", "ev_day", "n", *ok)


def slow_days(events: DataFrame, factor: float = 2.0, least: int = 20, eps: float = 0.01) -> DataFrame:
    """(tool, ev_day): days with at least ``least`` values whose p50 is above ``factor`` times the tool's p50."""
    p = cut(tool_percentiles(events, eps))
    whole = p.where("ev_day = 'all'").select("tool", F.col("p50").alias("whole"))
    return p.where(f"ev_day <> 'all' and n >= {least}").join(whole, "tool").where(F.col("p50") > factor * F.col("whole")).select("tool", "ev_day")
