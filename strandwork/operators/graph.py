"""Iterative graph operators over edge tables.

Loops run on the driver, one level of the graph a round; each round's frontier is written to the shared folder, so that a
plan never grows with the number of rounds and a lost executor costs no more than the round it was in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.util import cut, drop_cut


def _fixpoint_max(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, color): the greatest color that reaches each node along edges (src, dst)."""
    color = cut(start)
    changed = color
    while not changed.isEmpty():
        offer = edges.join(changed.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("offer"))
        changed = cut(color.join(offer, "id").where("offer > color").select("id", F.col("offer").alias("color")))
        old = color
        color = cut(color.join(changed.withColumnRenamed("color", "c2"), "id", "left").select("id", F.greatest("color", F.coalesce("c2", "color")).alias("color")))
        drop_cut(old)
    return color


#: Edges of a quotient in which one task finds the strong components.
LOCAL_EDGES = 100_000


def strong_components(edges: DataFrame, src: str = "caller_id", dst: str = "callee_id") -> DataFrame:
    """(id, component, size, self_loop): strong components; component is the smallest member id.

    Leaves are raked and chains contracted first (see hierarchy.py), so that deep graphs take few rounds. Null ids are
    ignored, repeated edges count once.
    """
    from strandwork.operators.hierarchy import resolve_hierarchy

    e = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct())
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    # cycles alone take a task one pass over its edges, so a quotient may be larger than where paths are asked for
    _, flags = resolve_hierarchy(e, "src", "dst", every_ancestor=None, max_local_edges=LOCAL_EDGES)
    member = cut(flags.where("state = 1").select(F.col("node").alias("id"), "scc"))
    named = member.groupBy("scc").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size"))
    loops = e.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("self_loop"))
    return nodes.join(member.join(named, "scc").drop("scc"), "id", "left").join(loops, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"), F.coalesce("size", F.lit(1)).cast("long").alias("size"),
        F.coalesce("self_loop", F.lit(False)).alias("self_loop"),
    )


def components_by_colour(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """The same without contraction, for graphs that it cannot shrink.

    Nodes without an incoming or outgoing edge are trimmed first, round by round, as each is its own component. What is
    left is coloured: the greatest id that reaches a node is its colour, and the nodes of a colour that lead back to
    that id are one component. Null ids are ignored, repeated edges count once.
    """
    e = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct())
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    loops = e.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("self_loop"))
    live = cut(e.where("src <> dst"))
    done = None
    while not live.isEmpty():
        n = -1
        while n != (n := live.count()) and n:
            live = cut(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        if not n:
            break
        ids = live.select(F.col("src").alias("id")).distinct()
        color = _fixpoint_max(live, ids.withColumn("color", F.col("id")))
        same = cut(
            live.join(color.select(F.col("id").alias("src"), F.col("color").alias("c1")), "src")
            .join(color.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("color"))
        )
        part = cut(color.where("id = color"))
        front = part
        while not front.isEmpty():
            back = same.join(front.select(F.col("id").alias("dst"), F.col("color").alias("fc")), "dst").where("fc = color")
            front = cut(back.select(F.col("src").alias("id"), "color").distinct().join(part, ["id", "color"], "left_anti"))
            part = cut(part.unionByName(front))
        done = part if done is None else done.unionByName(part)
        live = cut(live.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if done is None:
        comp = nodes.select("id", F.col("id").alias("component"), F.lit(1).cast("long").alias("size"))
    else:
        named = done.groupBy("color").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size"))
        comp = nodes.join(done.join(named, "color").drop("color"), "id", "left").select(
            "id", F.coalesce("component", "id").alias("component"), F.coalesce("size", F.lit(1)).cast("long").alias("size")
        )
    return comp.join(loops, "id", "left").select("id", "component", "size", F.coalesce("self_loop", F.lit(False)).alias("self_loop"))


def links(edges: DataFrame, src: str = "caller_id", dst: str = "callee_id") -> DataFrame:
    """(src, dst) distinct, without nulls and self-loops, written once for several searches."""
    return cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct())


def bfs(edges: DataFrame, seeds: DataFrame, src: str = "caller_id", dst: str = "callee_id", max_depth: int | None = None, skip_prefix: str | None = "external::", ready: bool = False) -> DataFrame:
    """(seed, id, depth): nodes reached from each seed (column id) with the least number of steps, seeds at 0.

    Level-synchronous over all seeds at once: one join and one anti-join a level. Ids with skip_prefix are not entered.
    For the way up, swap src and dst. Without max_depth the search runs until nothing new is reached. ready: edges are
    links() already, whose columns src and dst name.
    """
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")) if ready else links(edges, src, dst)
    if skip_prefix:
        e = e.where(~F.col("dst").startswith(skip_prefix))
    seen = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).where("id is not null").distinct())
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = e.join(front.select("seed", F.col("id").alias("src")), "src").select("seed", F.col("dst").alias("id")).distinct()
        front = cut(new.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def depths_from_roots(edges: DataFrame, src: str = "caller_id", dst: str = "callee_id") -> DataFrame:
    """(id, depth): least number of steps from any node without an incoming edge, -1 where none leads to it."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    e = cut(e)
    seen = front = cut(nodes.join(e.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("depth", F.lit(0)))
    depth = 0
    while not front.isEmpty():
        depth += 1
        new = e.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = cut(new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return nodes.join(seen, "id", "left").select("id", F.coalesce("depth", F.lit(-1)).alias("depth"))


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_steps: int = 6, src: str = "caller_id", dst: str = "callee_id") -> DataFrame:
    """(path, length): all simple paths of at most max_steps from a source to a target (columns id).

    Only nodes from which a target can still be reached in the steps left are entered, found by one search backwards.
    """
    e = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct())
    back = bfs(e, targets, "dst", "src", max_steps, None).groupBy("id").agg(F.min("depth").alias("left"))
    back = cut(back)
    front = cut(sources.select("id").distinct().join(back, "id").select(F.array("id").alias("path"), F.col("id").alias("at")))
    goal = targets.select(F.col("id").alias("at")).distinct()
    found = []
    for step in range(1, max_steps + 1):
        ahead = e.join(back.where(F.col("left") <= max_steps - step).select(F.col("id").alias("dst")), "dst", "left_semi")
        front = cut(
            front.join(ahead.withColumnRenamed("src", "at"), "at").where(~F.array_contains("path", F.col("dst")))
            .select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        )
        found.append(front.join(goal, "at", "left_semi").select("path", F.lit(step).alias("length")))
        if front.isEmpty():
            break
        front = front.join(goal, "at", "left_anti")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_steps: int = 6, k: int = 10, src: str = "caller_id", dst: str = "callee_id") -> DataFrame:
    """(source, target, path, length): for each pair the k shortest ways of the least length, of at most max_steps, in the
    order of their ids.

    A shortest way is one step followed by a shortest way, so a node keeps k ways to each target, found level by level
    from the targets; the work grows with the nodes around the targets, not with the number of ways.
    """
    e = links(edges, src, dst)
    goal = cut(targets.select("id").where("id is not null").distinct())
    dist = cut(bfs(e, goal, "dst", "src", max_steps, None, ready=True).select(F.col("seed").alias("target"), "id", "depth"))
    ways = cut(goal.select(F.col("id").alias("target"), "id", F.array("id").alias("path")))
    start = cut(sources.select("id").where("id is not null").distinct())
    found = []
    for depth in range(1, max_steps + 1):
        here = dist.where(F.col("depth") == depth).select("target", "id")
        step = ways.withColumnRenamed("id", "dst").join(e, "dst").select("target", F.col("src").alias("id"), "path").join(here, ["target", "id"], "left_semi")
        step = step.select("target", "id", F.concat(F.array("id"), "path").alias("path"))
        rank = F.row_number().over(Window.partitionBy("target", "id").orderBy("path"))
        ways = cut(step.withColumn("i", rank).where(F.col("i") <= k).drop("i"))
        if ways.isEmpty():
            break
        found.append(ways.join(start, "id", "left_semi").select(F.col("id").alias("source"), "target", "path", F.lit(depth).alias("length")))
    if not found:
        return ways.select(F.col("id").alias("source"), "target", "path", F.lit(0).alias("length")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def pagerank(edges: DataFrame, src: str = "source", dst: str = "target", damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, rank): (1-d)/n + d * what flows in, without spreading the rank of dead ends; at most rounds, or until the
    greatest change is below tolerance; divided by the greatest rank, or 0.001."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    e = cut(e.join(out, "src"))
    ids = cut(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    rank = cut(ids.withColumn("rank", F.lit(1.0 / n)))
    for _ in range(rounds):
        flow = e.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("n_out")).alias("flow"))
        new = cut(rank.join(flow, "id", "left").select("id", F.col("rank").alias("old"), (F.lit((1 - damping) / n) + damping * F.coalesce("flow", F.lit(0.0))).alias("rank")))
        drop_cut(rank)
        rank = new.select("id", "rank")
        if tolerance is not None and new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
            break
    top = max(rank.agg(F.max("rank")).first()[0], 0.001)
    return rank.select("id", (F.col("rank") / F.lit(top)).alias("rank"))


def communities(edges: DataFrame, nodes: DataFrame, src: str = "caller_id", dst: str = "callee_id", rounds: int = 15) -> DataFrame:
    """(id, community) of each of nodes (id): label propagation over the undirected links among them, all nodes at a time.

    A node takes the label that most of its neighbours have, the smallest of several; it keeps its own where that is
    among them; one without links is a community by itself. Counting labels combines on the map side, so a hub's
    neighbours are counted where they lie.
    """
    ids = cut(nodes.select("id").where("id is not null").distinct())
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    e = e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    e = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(e.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = e.join(label.withColumnRenamed("id", "b"), "b").groupBy("a", "community").agg(F.count(F.lit(1)).alias("n"))
        own = label.select(F.col("id").alias("a"), F.col("community").alias("own"))
        best = votes.join(own, "a").groupBy("a", "own").agg(
            F.min(F.struct(-F.col("n"), (F.col("community") != F.col("own")).cast("int").alias("other"), "community")).alias("m")
        )
        new = cut(best.select(F.col("a").alias("id"), F.col("m.community").alias("community"), (F.col("m.community") != F.col("own")).alias("moved")))
        drop_cut(label)
        label = new.select("id", "community")
        if new.where("moved").isEmpty():
            break
    return ids.join(label, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def _brandes(up: tuple[np.ndarray, ...], down: tuple[np.ndarray, ...], s: int) -> np.ndarray:
    """Each node's share of the shortest paths from node s: up and down hold each node's links (first, number, ends).

    A level takes the links from the last level's nodes, or those into nodes not reached yet, whichever are fewer.
    """
    n = len(up[1])

    def fan(x: tuple[np.ndarray, ...], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in v, other end) of all links of nodes v."""
        k = x[1][v]
        own = np.repeat(np.arange(len(v)), k)
        return own, x[2][np.arange(len(own)) + np.repeat(x[0][v] - (np.cumsum(k) - k), k)]

    ways, left = np.zeros(n), np.ones(n, bool)
    into = down[1].sum() - down[1][s]
    ways[s], left[s] = 1.0, False
    front, steps = np.array([s]), []
    last = np.zeros(n, bool)
    while True:
        if up[1][front].sum() <= into:
            own, w = fan(up, front)
            new = left[w]
            v, w = front[own[new]], w[new]
        else:
            last[front] = True
            rest = np.flatnonzero(left)
            own, v = fan(down, rest)
            new = last[v]
            v, w = v[new], rest[own[new]]
            last[front] = False
        if not len(w):
            break
        steps.append((v, w))
        ways += np.bincount(w, ways[v], n)
        before, left[w] = left.copy(), False
        front = np.flatnonzero(before & ~left)
        into -= down[1][front].sum()
    share = np.zeros(n)
    for v, w in reversed(steps):
        share += np.bincount(v, ways[v] / ways[w] * (1 + share[w]), n)
    share[s] = 0.0
    return share


def betweenness(edges: DataFrame, src: str = "source", dst: str = "target", max_edges: int = 20_000_000) -> DataFrame:
    """(id, betweenness): shortest paths through each node over all sources, directed, unweighted, divided by the greatest
    (or 1). Nodes are numbered and the links sent to all tasks as numbers, behind a check of how many they are; sources are
    shared out over the tasks.

    Beyond max_edges the same search runs as joins, for a block of sources at a time.
    """
    spark = edges.sparkSession
    e = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct())
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    if e.count() > max_edges:
        return _betweenness_joins(e, ids)
    named = cut(ids.withColumn("k", (F.row_number().over(Window.orderBy("id")) - 1).cast("long")))
    coded = e.join(named.select(F.col("id").alias("src"), F.col("k").cast("int").alias("a")), "src").join(named.select(F.col("id").alias("dst"), F.col("k").cast("int").alias("b")), "dst")
    pairs = cut(coded.select("a", "b")).toArrow()
    a, b, n = pairs["a"].to_numpy().astype(np.int64), pairs["b"].to_numpy().astype(np.int64), named.count()
    if not n:
        return ids.withColumn("betweenness", F.lit(0.0))

    def ends(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        k = np.bincount(x, minlength=n)
        return np.cumsum(k) - k, k, y[np.argsort(x, kind="stable")]

    sent = spark.sparkContext.broadcast((ends(a, b), ends(b, a)))

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up, down = sent.value
        total = np.zeros(n)
        for x in batches:
            for s in x["id"]:
                if up[1][s]:
                    total += _brandes(up, down, s)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"k": some, "part": total[some]})

    tasks = min(n, spark.sparkContext.defaultParallelism * 4)
    parts = spark.range(0, n, 1, tasks).mapInPandas(shares, "k long, part double").groupBy("k").agg(F.sum("part").alias("b"))
    return _scaled(ids, named.join(parts, "k").select("id", "b"))


def _scaled(ids: DataFrame, b: DataFrame) -> DataFrame:
    b = cut(b)
    top = max(b.agg(F.max("b")).first()[0] or 1.0, 1.0)
    return ids.join(b, "id", "left").select("id", F.coalesce(F.col("b") / F.lit(top), F.lit(0.0)).alias("betweenness"))


#: Pairs of a source and a node that one block of sources may reach while betweenness runs as joins.
PAIRS_PER_BLOCK = 20_000_000


def _betweenness_joins(e: DataFrame, ids: DataFrame) -> DataFrame:
    """The same as joins: a block of sources goes forward level by level counting ways, then back sharing them out; what
    a block has written is deleted before the next."""
    ids = cut(ids)
    n = ids.count()
    blocks = max(1, -(-n * n // PAIRS_PER_BLOCK))
    total = None
    for k in range(blocks):
        part = _share_of_block(e, ids.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k))
        old, total = total, part if total is None else cut(total.unionByName(part).groupBy("id").agg(F.sum("b").alias("b")))
        if old is not None:
            drop_cut(old, part)
    return _scaled(ids, total)


def _share_of_block(e: DataFrame, sources: DataFrame) -> DataFrame:
    none = F.lit(0)
    levels = [cut(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("ways"), none.alias("depth")))]
    seen = levels[0].select("s", "id")
    while True:
        last = levels[-1]
        nxt = e.join(last.withColumnRenamed("id", "src"), "src").groupBy("s", F.col("dst").alias("id")).agg(F.sum("ways").alias("ways"))
        nxt = cut(nxt.join(seen, ["s", "id"], "left_anti").withColumn("depth", F.lit(len(levels))))
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select("s", "id"))
    share = cut(levels[-1].select("s", "id", F.lit(0.0).alias("share")))
    total, old = None, [share]
    for k in range(len(levels) - 1, 0, -1):
        low = levels[k].join(share, ["s", "id"])
        upper = levels[k - 1].select("s", F.col("id").alias("src"), F.col("ways").alias("w0"))
        part = e.join(low.withColumnRenamed("id", "dst"), "dst").join(upper, ["s", "src"])
        part = part.groupBy("s", F.col("src").alias("id")).agg(F.sum(F.col("w0") / F.col("ways") * (1 + F.col("share"))).alias("share"))
        share = cut(levels[k - 1].select("s", "id").join(part, ["s", "id"], "left").select("s", "id", F.coalesce("share", F.lit(0.0)).alias("share")))
        if k > 1:
            total = share if total is None else total.unionByName(share)
        old.append(share)
    out = cut((share.limit(0) if total is None else total).where("s <> id").groupBy("id").agg(F.sum("share").alias("b")))
    drop_cut(*levels, *old)
    return out


#: Edges of a strong component that one task searches for cycles.
SMALL_COMPONENT = 5_000


def _shortest_cycles(part: pd.DataFrame) -> pd.DataFrame:
    """For each node of one component the shortest cycle through it, of several the one whose ids come first."""
    down: dict[str, list[str]] = {}
    for a, b in zip(part.src, part.dst):
        down.setdefault(a, []).append(b)
    for ends in down.values():
        ends.sort()
    out = set()
    for seed in down:
        # level by level, nodes in the order of their ways, so the first way to a node is the least of its length
        level, before, found = [seed], {}, None
        while level and found is None:
            nxt = []
            for v in level:
                for w in down[v]:
                    if w == seed:
                        found = v
                        break
                    if w not in before:
                        before[w] = v
                        nxt.append(w)
                if found is not None:
                    break
            level = nxt
        way = [found]
        while way[-1] != seed:
            way.append(before[way[-1]])
        way.reverse()
        k = way.index(min(way))
        out.add(tuple(way[k:] + way[:k]))
    return pd.DataFrame({"cycle": [list(c) for c in sorted(out)], "length": [len(c) for c in sorted(out)]})


def cycles(edges: DataFrame, src: str = "parent_id", dst: str = "child_id", small: int = SMALL_COMPONENT) -> DataFrame:
    """(cycle, length): for each node on a cycle the shortest one through it, of several the one whose ids come first;
    each cycle once, its smallest id first, whatever its length.

    Strong components come from the contraction of hierarchy.py. One of at most ``small`` edges is searched in one task;
    in greater ones all nodes are searched from at once, in rounds of joins: a node's search ends with its cycle, and
    keeps one way to each node it has reached.
    """
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    comp = cut(strong_components(e, "src", "dst").where("size > 1 or self_loop").select("id", "component"))
    inner = cut(
        e.join(comp.select(F.col("id").alias("src"), F.col("component").alias("c1")), "src")
        .join(comp.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").where("c1 = c2").select(F.col("c1").alias("component"), "src", "dst")
    )
    big = cut(inner.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("component"))
    near = inner.join(big, "component", "left_anti").groupBy("component").applyInPandas(_shortest_cycles, "cycle array<string>, length int").distinct()
    if big.isEmpty():
        return near
    return near.unionByName(_cycles_in_rounds(inner.join(big, "component", "left_semi").select("src", "dst"), comp.join(big, "component", "left_semi")))


def _cycles_in_rounds(inner: DataFrame, comp: DataFrame) -> DataFrame:
    front = cut(comp.select(F.col("id").alias("seed"), F.col("id").alias("src"), F.array("id").alias("path")))
    seen = front.select("seed", F.col("src").alias("dst")).limit(0)
    out = None
    while not front.isEmpty():
        step = cut(front.join(inner, "src").select("seed", "dst", "path"))
        closed = cut(step.where("dst = seed").groupBy("seed").agg(F.min("path").alias("cycle")))
        out = closed if out is None else out.unionByName(closed)
        ahead = step.join(closed.select("seed"), "seed", "left_anti").join(seen, ["seed", "dst"], "left_anti")
        front = cut(ahead.groupBy("seed", "dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path")).select("seed", F.col("dst").alias("src"), "path"))
        seen = cut(seen.join(closed.select("seed"), "seed", "left_anti").unionByName(front.select("seed", F.col("src").alias("dst"))))
    if out is None:
        return front.select(F.col("path").alias("cycle"), F.lit(0).alias("length"))
    first = F.array_position("cycle", F.array_min("cycle")).cast("int")
    turned = F.concat(F.slice("cycle", first, F.size("cycle")), F.slice("cycle", F.lit(1), first - 1))
    return out.select(turned.alias("cycle"), F.size("cycle").alias("length")).distinct()


def adjacency_with_overrides(calls: DataFrame, links: DataFrame, methods: DataFrame, limit: int = 200) -> DataFrame:
    """(src, dst, via): calls, and for each parent-child pair of classes all pairs of their methods, unless there are more
    than limit of them. links (parent_id, child_id), methods (class_id, id)."""
    n = methods.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = (
        links.select("parent_id", "child_id").distinct()
        .join(n.select(F.col("class_id").alias("parent_id"), F.col("n").alias("n1")), "parent_id")
        .join(n.select(F.col("class_id").alias("child_id"), F.col("n").alias("n2")), "child_id").where(F.col("n1") * F.col("n2") <= limit)
    )
    up = methods.select(F.col("class_id").alias("parent_id"), F.col("id").alias("src"))
    low = methods.select(F.col("class_id").alias("child_id"), F.col("id").alias("dst"))
    extra = pairs.join(up, "parent_id").join(low, "child_id").select("src", "dst", F.lit("inheritance").alias("via"))
    own = calls.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.lit("call").alias("via")).where("src is not null and dst is not null")
    return own.unionByName(extra).distinct()


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(id, fan_in, fan_out, upstream, downstream, blast, risk, level) of each seed (column id).

    risk is at most 100: 4 per caller, 2 per callee, 20 for a hub and 1.5 per node within depth either way.
    """
    from strandwork.operators.callgraph import HUB_FAN_IN, degrees
    from strandwork.util import js_round

    seeds = cut(seeds.select("id"))
    e = links(edges)
    up = bfs(e, seeds, "dst", "src", depth, ready=True).where("depth > 0").groupBy("seed").agg(F.count(F.lit(1)).alias("upstream"))
    down = bfs(e, seeds, "src", "dst", depth, ready=True).where("depth > 0").groupBy("seed").agg(F.count(F.lit(1)).alias("downstream"))
    d = degrees(nodes, edges).join(seeds.select("id").distinct(), "id", "left_semi")
    d = d.join(up.withColumnRenamed("seed", "id"), "id", "left").join(down.withColumnRenamed("seed", "id"), "id", "left").fillna(0, ["upstream", "downstream"])
    d = d.withColumn("blast", F.col("upstream") + F.col("downstream"))
    risk = js_round(4 * F.col("fan_in") + 2 * F.col("fan_out") + F.when(F.col("fan_in") >= HUB_FAN_IN, 20).otherwise(0) + 1.5 * F.col("blast"))
    level = F.when(F.col("risk") <= 20, "low").when(F.col("risk") <= 45, "medium").when(F.col("risk") <= 70, "high").otherwise("critical")
    return d.withColumn("risk", F.least(F.lit(100), risk).cast("int")).withColumn("level", level)
