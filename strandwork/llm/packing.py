"""Filling fixed-capacity containers with items, by dominance reduction and best fit.

Sizes are whole numbers up to the capacity, so any number of items is, for packing, a histogram of at most ``capacity``
counts. The containers are planned on that histogram: Martello and Toth's dominance criterion fixes sets of up to three
sizes that no better container can exist for, each as often as the counts allow, and best fit in decreasing order packs
what is left, all containers of equal filling being treated as one group. The plan says which ranks of each size go to
which containers; the items get their ranks and places in Spark, so nothing but the histogram reaches the driver.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm.bpe import VOCABULARY, token_counts
from strandwork.util import cut, partitions

CAPACITY = 2048
#: Ranks per block in the join of items with the plan.
BLOCK = 4096


def _reduce(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Fix dominating sets: [(sizes of a container, how many such containers)], taken out of counts."""
    fixed: list[tuple[list[int], int]] = []
    sizes = sorted(counts)

    def take(group: list[int], times: int) -> None:
        fixed.append((group, times))
        for s in group:
            counts[s] -= times
        for s in set(group):
            if not counts[s]:
                sizes.pop(bisect_left(sizes, s))

    def free(s: int, *used: int) -> int:
        return counts.get(s, 0) - used.count(s)

    def largest(room: int, *used: int) -> int:
        """The largest size that fits and is still there besides the used ones, or 0."""
        i = bisect_right(sizes, room) - 1
        while i >= 0 and free(sizes[i], *used) <= 0:
            i -= 1
        return sizes[i] if i >= 0 else 0

    def smallest(n: int, *used: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(n - len(out), max(0, free(s, *used)))
            if len(out) == n:
                break
        return out

    def times(group: list[int]) -> int:
        return min(counts[s] // group.count(s) for s in set(group))

    changed = True
    while changed:
        changed = False
        for j in sorted(sizes, reverse=True):
            while counts.get(j):
                room = capacity - j
                low = smallest(3, j)
                if not low or low[0] > room:
                    take([j], counts[j])
                    changed = True
                    continue
                a = largest(room, j)
                two = len(low) > 1 and low[0] + low[1] <= room
                if a == room or not two:
                    # one partner at most, or the container is full: nothing beats the largest that fits
                    take([j, a], times([j, a]))
                    changed = True
                    continue
                if len(low) > 2 and sum(low) <= room:
                    break
                # two partners at most: the best pair, and the largest size that occurs twice-over in a pair
                best, pair, even = 0, (0, 0), 0
                for c in sizes[: bisect_right(sizes, room)]:
                    if free(c, j) <= 0:
                        continue
                    d = largest(room - c, j, c)
                    if d and c + d > best:
                        best, pair = c + d, (max(c, d), min(c, d))
                    if d:
                        even = max(even, min(c, d))
                if a >= best:
                    take([j, a], times([j, a]))
                elif pair[0] == a and pair[1] >= even:
                    take([j, *pair], times([j, *pair]))
                else:
                    break
                changed = True
    return fixed


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing over equal containers taken together: [(sizes, how many)]."""
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, group: list[int], times: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([group, times])

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                put(capacity - each * s, [s] * each, left // each)
                if left % each:
                    put(capacity - (left % each) * s, [s] * (left % each), 1)
                left = 0
                continue
            room = rooms[i]
            group, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            each = room // s
            full = min(times, left // each)
            left -= full * each
            put(room - each * s, group + [s] * each, full)
            times -= full
            if times and left:
                # fewer than one container's worth is left
                put(room - left * s, group + [s] * left, 1)
                left, times = 0, times - 1
            put(room, group, times)
    return [(g, n) for parts in open_.values() for g, n in parts]


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], int]:
    """([(sizes of a container, how many such)], number of sets fixed by dominance) for counts of sizes 1..capacity."""
    counts = {s: n for s, n in histogram.items() if n}
    fixed = _reduce(counts, capacity)
    rest = _best_fit({s: n for s, n in counts.items() if n}, capacity)
    return fixed + rest, sum(n for _, n in fixed)


def plan_rows(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, end rank, first container, items of the size per container, first position)."""
    rows, base, used = [], 0, {}
    for group, times in plan:
        group = sorted(group, reverse=True)
        at = 0
        while at < len(group):
            s = group[at]
            each = group.count(s)
            first = used.get(s, 0)
            used[s] = first + each * times
            rows.append((s, first, used[s], base, each, at))
            at += each
        base += times
    return rows


def _pieces(items: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, first_token, size): the items, those above the capacity in full pieces and a rest."""
    n = F.col("n_tokens").cast("long")
    return (
        items.where("n_tokens > 0")
        .select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / capacity))).alias("k"))
        .select("doc_id", (F.col("k") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n") - F.col("k") * capacity).cast("int").alias("size"))
    )


def fill_containers(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, position, doc_id, first_token, n_tokens) from items (doc_id, n_tokens).

    An item above the capacity is split into full pieces and a rest, no other is; items of null, zero or negative size
    are left out. Items that share an id are separate items. An empty table gives no containers. The same items give
    the same containers, whatever their order.
    """
    spark = items.sparkSession
    pieces = cut(_pieces(items, capacity).withColumn("slice", F.pmod(F.xxhash64("doc_id", "first_token"), F.lit(max(16, partitions(spark))))))
    per = cut(pieces.groupBy("size", "slice").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["size"]: r["n"] for r in per.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_containers(histogram, capacity)
    schema = "size int, r0 long, r1 long, base long, each long, at long"
    rows = plan_rows(plan)
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["size", "r0", "r1", "base", "each", "at"]), schema) if rows else spark.createDataFrame([], schema)
    blocks = table.withColumn("block", F.explode(F.sequence(F.floor(F.col("r0") / BLOCK), F.floor((F.col("r1") - 1) / BLOCK))))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("slice")) - F.col("n")).drop("n")
    place = Window.partitionBy("size", "slice").orderBy("doc_id", "first_token")
    ranked = pieces.withColumn("i", F.row_number().over(place)).join(before, ["size", "slice"]).withColumn("rank", F.col("before") + F.col("i") - 1)
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)).select("doc_id", "first_token", "size", "rank", "block")
    both = ranked.join(blocks, ["size", "block"]).where("rank >= r0 and rank < r1")
    off = F.col("rank") - F.col("r0")
    return both.select(
        (F.col("base") + F.floor(off / F.col("each"))).alias("container_id"),
        (F.col("at") + off % F.col("each")).cast("int").alias("position"),
        "doc_id", "first_token", F.col("size").cast("long").alias("n_tokens"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """fill_containers over the token counts of documents; empty and null texts are left out."""
    return fill_containers(token_counts(docs, path=path), capacity)


def packing_report(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row on the plan for items (doc_id, n_tokens): n_pieces, n_tokens, n_containers, the least that their volume
    needs, n_fixed (containers fixed by dominance) and fill, the share of the space that is used (null without items)."""
    spark = items.sparkSession
    histogram = {r["size"]: r["n"] for r in _pieces(items, capacity).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, fixed = plan_containers(histogram, capacity)
    pieces, tokens, n = sum(histogram.values()), sum(s * k for s, k in histogram.items()), sum(k for _, k in plan)
    row = (pieces, tokens, n, -(-tokens // capacity), fixed, tokens / (n * capacity) if n else None)
    return spark.createDataFrame([row], "n_pieces long, n_tokens long, n_containers long, least long, n_fixed long, fill double")


def packing_summary(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """packing_report over the token counts of documents."""
    return packing_report(token_counts(docs, path=path), capacity)
