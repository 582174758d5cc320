"""Parent-child rows of unknown depth to full hierarchies.

Method: tree contraction. Each level first rakes the leaves (their answer follows from their parents'), then, within
every partition, follows chains of single-parent nodes to the first node outside the partition's fragment. Only
fragment exits and nodes with several parents go on to the smaller quotient, which is solved recursively; a quotient
of at most ``max_local_edges`` edges is solved in one task, but every table is contracted at least once (unless only
cycles are asked for). Answers then
expand back level by level: a node's rows are its exit's rows, moved down by the length of the fragment path. Cycles
show up locally (a chain that never leaves its fragment becomes a loop at one representative) or globally (strong
components of the quotient).

Where that leaves more than half of the edges, nodes with several parents are taken out as well, if it adds no edges:
such a node, none of whose neighbours goes at the same level, is replaced by an edge from each of its children to each
of its parents. Three levels in a row that leave more than nine tenths (a dense quotient) are followed by a plain
fixpoint over the rest.

Cost: every level is a fixed number of shuffles over a shrinking edge set. Rows are placed by a hash of the chain's
head so that neighbouring single-parent nodes meet in one partition in every level, whatever the number of partitions;
children of a very wide parent stay in places of their own, so that no place grows with a parent's width. The nodes on
a fragment path are carried along only where paths or all ancestors are asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.util import cut, drop_cut, partitions

#: Largest quotient, in edges, that one task solves.
MAX_LOCAL_EDGES = 2_000
#: Edges per partition while chains are contracted, as long as there are no more partitions than shuffles have (or 64).
ROWS_PER_PARTITION = 20_000
#: Children that one parent may draw to its place; and at least 1/2000 of all edges, so that few parents are wider.
WIDE = 10_000

_SOLVED = "node string, target string, depth int, path array<string>, state int, scc string"


def _components(up: dict[str, list[str]]) -> dict[str, str]:
    """Strong components with a cycle in them: node -> smallest member. Iterative, so depth is no limit."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: dict[str, str] = {}
    for start in up:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        work = [(start, iter(up[start]))]
        while work:
            v, it = work[-1]
            for u in it:
                if u not in index:
                    index[u] = low[u] = len(index)
                    stack.append(u)
                    on.add(u)
                    work.append((u, iter(up.get(u, ()))))
                    break
                if u in on:
                    low[v] = min(low[v], index[u])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        m = stack.pop()
                        on.discard(m)
                        members.append(m)
                        if m == v:
                            break
                    if len(members) > 1 or v in up.get(v, ()):
                        name = min(members)
                        out.update((m, name) for m in members)
    return out


def _below(seeds: set[str], down: dict[str, list[str]]) -> set[str]:
    seen, todo = set(seeds), list(seeds)
    while todo:
        for c in down.get(todo.pop(), ()):
            if c not in seen:
                seen.add(c)
                todo.append(c)
    return seen


def solve_local(edges: list[tuple[str, str, int, list[str]]], every_ancestor: bool | None, paths: bool) -> Iterator[tuple]:
    """Solve one bounded edge list of (child, parent, weight, nodes between): rows as in _SOLVED."""
    best: dict[tuple[str, str], tuple[int, list[str]]] = {}
    for child, parent, w, via in edges:
        got = best.get((child, parent))
        if got is None or (w, via) < got:
            best[child, parent] = (w, via)
    up: dict[str, list[str]] = {}
    down: dict[str, list[str]] = {}
    for child, parent in best:
        up.setdefault(child, []).append(parent)
        down.setdefault(parent, []).append(child)
    scc = _components(up)
    touched = _below(set(scc), down)
    for v in up:
        if v in touched:
            yield v, None, None, None, 1 if v in scc else 2, scc.get(v)
    if every_ancestor is None:
        return
    targets = list(down) if every_ancestor else [p for p in down if p not in up]
    for t in targets:
        dist: dict[str, int] = {}
        order = []
        heap = [(best[c, t][0], c) for c in down[t]]
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            if v == t:
                continue
            for c in down.get(v, ()):
                if c not in dist:
                    heapq.heappush(heap, (d + best[c, v][0], c))
        if not paths:
            for v in order:
                yield v, t, dist[v], None, None, None
            continue
        chosen: dict[str, list[str]] = {}
        for v in order:
            options = []
            for p in up[v]:
                w, via = best[v, p]
                if p == t and w == dist[v]:
                    options.append([*via, t])
                elif p != t and p in chosen and dist[p] + w == dist[v]:
                    options.append([*via, p, *chosen[p]])
            chosen[v] = min(options)
            yield v, t, dist[v], chosen[v], None, None


def _local_solver(every_ancestor: bool, paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = [(c, p, int(w), list(v)) for b in batches for c, p, w, v in zip(b.child, b.parent, b.w, b.via)]
        names = ["node", "target", "depth", "path", "state", "scc"]
        kinds = {"depth": "Int32", "state": "Int32"}
        block: list[tuple] = []
        for row in solve_local(edges, every_ancestor, paths):
            block.append(row)
            if len(block) == 20_000:
                yield pd.DataFrame(block, columns=names).astype(kinds)
                block = []
        if block:
            yield pd.DataFrame(block, columns=names).astype(kinds)

    return run


def _chains(keep: bool):
    """Each partition-local single-parent node with its fragment exit, the steps to it, the nodes between if kept, its
    parent and the number of the partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        up = {c: (p, int(w), list(v)) for b in batches for c, p, w, v in zip(b.child, b.parent, b.w, b.via)}
        done: dict[str, tuple[str, int, list[str]]] = {}
        for start in up:
            trail: list[str] = []
            at: dict[str, int] = {}
            v = start
            while v in up and v not in done and v not in at:
                at[v] = len(trail)
                trail.append(v)
                v = up[v][0]
            if v in at:
                # a loop within the fragment: its smallest node stands for it and keeps an edge to itself
                loop = trail[at[v] :]
                k = loop.index(min(loop))
                loop = loop[k:] + loop[:k]
                rep = loop[0]
                w, via = 0, []
                for m in reversed(loop[1:]):
                    p, step, between = up[m]
                    w, via = w + step, ([*between, *([p] if p != rep else []), *via] if keep else via)
                    done[m] = (rep, w, via)
                _, step, between = up[rep]
                done[rep] = (rep, w + step, [*between, *([loop[1], *via] if len(loop) > 1 else [])] if keep else [])
                trail = trail[: at[v]]
            for u in reversed(trail):
                p, w, via = up[u]
                if p in done and done[p][0] != p:
                    e, w2, via2 = done[p]
                    done[u] = (e, w + w2, [*via, p, *via2] if keep else via)
                else:
                    done[u] = (p, w, via)
        if done:
            rows = [(v, e, w, via, up[v][0], part) for v, (e, w, via) in done.items()]
            for i in range(0, len(rows), 20_000):
                yield pd.DataFrame(rows[i : i + 20_000], columns=["v", "exit", "xw", "xvia", "up", "part"])

    return run


def _climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows (v, up, scc) of contracted nodes and marks (v, scc), up null: all nodes above a mark on its fragment."""
    up: dict[str, str] = {}
    marks: dict[str, str] = {}
    for b in batches:
        for v, p, scc in zip(b.v, b.up, b.scc):
            if p is None:
                marks[v] = scc
            else:
                up[v] = p
    todo = list(marks)
    while todo:
        v = todo.pop()
        p = up.get(v)
        if p is not None and p in up and p not in marks:
            marks[p] = marks[v]
            todo.append(p)
    if marks:
        yield pd.DataFrame(list(marks.items()), columns=["node", "scc"])


def _least(edges: DataFrame) -> DataFrame:
    """One edge for each (child, parent): the shortest, then the one whose nodes between come first."""
    return (
        edges.groupBy("child", "parent")
        .agg(F.min(F.struct("w", "via")).alias("m"))
        .select("child", "parent", "m.w", "m.via")
    )


def _spread(edges: DataFrame, every: bool, paths: bool) -> tuple[DataFrame, DataFrame]:
    """The plain distributed fixpoint, for a quotient that no longer shrinks: relax until nothing improves."""
    from strandwork.operators.graph import components_by_colour

    e = cut(edges)
    parents = e.select(F.col("parent").alias("node")).distinct()
    if every is None:
        parents = parents.limit(0)
    start = parents if every else parents.join(e.select(F.col("child").alias("node")), "node", "left_anti")
    none = F.array().cast("array<string>")
    front = cut(start.select("node", F.col("node").alias("target"), F.lit(0).alias("depth"), none.alias("path")))
    known = front.limit(0)
    while not front.isEmpty():
        path = F.concat("via", F.array("parent"), "path") if paths else none
        step = (
            e.join(front.withColumnRenamed("node", "parent"), "parent")
            .where((F.col("parent") != F.col("target")) | (F.col("depth") == 0))
            .select(F.col("child").alias("node"), "target", (F.col("depth") + F.col("w")).alias("depth"), path.alias("path"))
            .groupBy("node", "target")
            .agg(F.min(F.struct("depth", "path")).alias("new"))
        )
        old = known.groupBy("node", "target").agg(F.min(F.struct("depth", "path")).alias("old"))
        better = step.join(old, ["node", "target"], "left").where("old is null or new < old")
        front = cut(better.select("node", "target", "new.depth", "new.path"))
        known = cut(
            known.unionByName(front)
            .groupBy("node", "target")
            .agg(F.min(F.struct("depth", "path")).alias("b"))
            .select("node", "target", "b.depth", "b.path")
        )
    scc = cut(components_by_colour(e, "child", "parent").where("size > 1 or self_loop").select(F.col("id").alias("node"), F.col("component").alias("scc")))
    seen = scc.select("node")
    front = seen
    while not front.isEmpty():
        front = cut(
            e.join(front.withColumnRenamed("node", "parent"), "parent", "left_semi")
            .select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti")
        )
        seen = cut(seen.unionByName(front))
    flags = seen.distinct().join(scc, "node", "left").select("node", F.when(F.col("scc").isNull(), 2).otherwise(1).alias("state"), "scc")
    return known, flags


def _solve(edges: DataFrame, every: bool | None, paths: bool, bound: int, level: int, stuck: int) -> tuple[DataFrame, DataFrame]:
    """(rows node, target, depth, path; flags node, state, scc) for the cut edge table."""
    n = edges.count()
    if not n or (n <= bound and (level or every is None)):
        out = cut(edges.repartition(1).mapInPandas(_local_solver(every, paths), _SOLVED))
        rows = out.where("target is not null").select("node", "target", "depth", "path")
        return rows, out.where("state is not null").select("node", "state", "scc")
    if stuck == (1 if every is None else 3):
        return _spread(edges, every, paths)

    keep = bool(every or paths)
    parents = edges.select(F.col("parent").alias("child")).distinct()
    leaves = edges.join(parents, "child", "left_anti")
    inner = cut(edges.join(parents, "child", "left_semi"))

    # chains: a child that flips tails joins its heads parent's place, so neighbours meet whatever the partitioning
    counts = inner.groupBy("child").agg(
        F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent"), F.first("w").alias("w"), F.first("via").alias("via")
    )
    heads = lambda c: F.pmod(F.xxhash64(F.lit(level), F.col(c)), F.lit(4)) == 0
    chain = counts.where("n = 1").select("child", "parent", "w", "via")
    # fewer than 2,000 parents are that wide, whatever n is
    wide = chain.groupBy("parent").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > max(WIDE, n // 2000)).select("parent", F.lit(True).alias("wide"))
    chain = chain.join(F.broadcast(wide), "parent", "left")
    key = F.when(~heads("child") & heads("parent") & F.col("wide").isNull(), F.col("parent")).otherwise(F.col("child"))
    placed = chain.repartition(max(1, min(-(-n // ROWS_PER_PARTITION), max(64, partitions(edges.sparkSession)))), key).select("child", "parent", "w", "via")
    x = cut(placed.mapInPandas(_chains(keep), "v string, exit string, xw int, xvia array<string>, up string, part int"))
    kept = x.select(F.col("exit").alias("v")).distinct()
    gone = cut(x.join(kept, "v", "left_anti"))
    stay = x.join(kept, "v", "left_semi").select(F.col("v").alias("child"), F.col("exit").alias("parent"), F.col("xw").alias("w"), F.col("xvia").alias("via"))
    several = inner.join(x.select(F.col("v").alias("child")), "child", "left_anti")
    moved = several.join(gone.withColumnRenamed("v", "parent"), "parent", "left").select(
        "child",
        F.coalesce("exit", "parent").alias("parent"),
        (F.col("w") + F.coalesce("xw", F.lit(0))).alias("w"),
        F.when(F.col("exit").isNull(), F.col("via")).otherwise(F.concat("via", F.array("parent"), "xvia") if keep else F.col("via")).alias("via"),
    )
    raw = cut(stay.unionByName(moved))
    whole = cut(_least(raw))
    left = whole.count()
    # raking and chains halve most tables; where they do not, nodes with several parents go as well
    quotient, taken, fill = _take_out(whole, keep, level) if left > max(bound, n // 2) else (whole, None, None)
    if taken is not None:
        left = quotient.count()
    rows, flags = _solve(quotient, every, paths, bound, level + 1, stuck + 1 if left > 0.9 * n else 0)

    # expand what was taken out, then chains, then leaves: a row of the exit, moved down
    flags = cut(flags)
    if taken is not None:
        rows = _between(fill, taken.select(F.col("child").alias("v")).distinct(), rows) if every else rows
        rows, flags = _lower(taken, cut(rows), flags, _mid_cycle(whole, taken, flags), edges, every, paths)
        rows, flags = cut(rows), cut(flags)
    rows = cut(_between(raw, x.select("v"), rows)) if every else rows
    lost = gone.select(F.col("v").alias("child"), F.col("exit").alias("parent"), F.col("xw").alias("w"), F.col("xvia").alias("via"))
    looped = cut(_on_cycles(inner, x, flags))
    # a node that stayed while its own fragment's edge passes over it: the quotient does not see what enters it that way
    passed = looped.join(gone.select(F.col("v").alias("node")), "node", "left_anti").select("node", F.lit(1).alias("state"), "scc")
    flags = cut(flags.unionByName(passed).groupBy("node").agg(F.min("state").alias("state"), F.max("scc").alias("scc")))
    rows, flags = _lower(lost, rows, flags, looped, edges, every, paths)
    rows, flags = cut(rows), cut(flags)
    drop_cut(inner, x, gone, raw, whole, looped, *([quotient, taken, fill] if taken is not None else []))
    rows, flags = _lower(leaves, rows, flags, None, edges, every, paths)
    return rows, flags


def _on_cycles(inner: DataFrame, chains: DataFrame, flags: DataFrame) -> DataFrame:
    """(node, scc): the nodes of chains on a cycle. One is if, at or below it on its fragment, a node of its exit's
    strong component enters; fragments are climbed in the partitions they were contracted in, over nodes that stayed too."""
    scc = flags.where("state = 1").select("node", "scc")
    held = chains.join(scc.select(F.col("node").alias("exit"), "scc"), "exit").select("v", "up", "scc", "part")
    marks = (
        inner.select("child", F.col("parent").alias("v")).join(held.select("v", "part", F.col("scc").alias("s1")), "v")
        .join(scc.select(F.col("node").alias("child"), F.col("scc").alias("s2")), "child").where("s1 = s2")
        .select("v", F.lit(None).cast("string").alias("up"), F.col("s1").alias("scc"), "part").distinct()
    )
    return held.unionByName(marks).repartition("part").mapInPandas(_climb, "node string, scc string")


def _take_out(whole: DataFrame, keep: bool, level: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(edges left, edges of the nodes taken out or None, the edges that replace them)."""
    loops = whole.where("child = parent").select(F.col("child").alias("v"))
    up = whole.groupBy(F.col("child").alias("v")).agg(F.count(F.lit(1)).alias("i"))
    down = whole.groupBy(F.col("parent").alias("v")).agg(F.count(F.lit(1)).alias("o"))
    able = up.join(down, "v").where("i > 1 and i * o <= i + o").join(loops, "v", "left_anti").select("v", F.xxhash64(F.lit(level), F.col("v")).alias("h"))
    able = cut(able)
    if able.isEmpty():
        return whole, None, None
    # of two neighbours the one with the smaller hash goes
    pairs = whole.join(able.select(F.col("v").alias("child"), F.col("h").alias("h1")), "child").join(able.select(F.col("v").alias("parent"), F.col("h").alias("h2")), "parent")
    beaten = pairs.select(F.when(F.struct("h1", "child") < F.struct("h2", "parent"), F.col("parent")).otherwise(F.col("child")).alias("v"))
    out = cut(able.join(beaten, "v", "left_anti").select("v"))
    taken = cut(whole.join(out.withColumnRenamed("v", "child"), "child", "left_semi"))
    into = whole.join(out.withColumnRenamed("v", "parent"), "parent", "left_semi")
    fill = into.join(taken.select(F.col("child").alias("parent"), F.col("parent").alias("p2"), F.col("w").alias("w2"), F.col("via").alias("via2")), "parent").select(
        "child", F.col("p2").alias("parent"), (F.col("w") + F.col("w2")).alias("w"),
        (F.concat("via", F.array("parent"), "via2") if keep else F.col("via")).alias("via"),
    )
    fill = cut(fill)
    rest = whole.join(out.withColumnRenamed("v", "child"), "child", "left_anti").join(out.withColumnRenamed("v", "parent"), "parent", "left_anti")
    return cut(_least(rest.unionByName(fill))), taken, fill


def _mid_cycle(whole: DataFrame, taken: DataFrame, flags: DataFrame) -> DataFrame:
    """(node, scc): nodes taken out that have a child and a parent in one strong component."""
    scc = flags.where("state = 1").select("node", "scc")
    above = taken.select(F.col("child").alias("v"), F.col("parent").alias("node")).join(scc, "node").select("v", "scc").distinct()
    below = whole.select(F.col("parent").alias("v"), F.col("child").alias("node")).join(scc, "node").select("v", "scc").distinct()
    return above.join(below, ["v", "scc"], "left_semi").select(F.col("v").alias("node"), "scc")


def _between(raw: DataFrame, here: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the ancestors that lie between the ends of the quotient's edges: the nodes v of here, contracted ones and
    those that stayed because another fragment ends there while an edge of their own fragment passes over them."""
    spots = F.transform("via", lambda x, i: F.struct(x.alias("t"), i.alias("i")))
    inside = raw.select("child", "via", F.explode(spots).alias("s")).join(here.select(F.col("v").alias("t")), F.col("s.t") == F.col("t"), "left_semi")
    inside = inside.select(
        "child", F.col("s.t").alias("t"), (F.col("s.i") + 1).cast("int").alias("w"), F.slice("via", 1, F.col("s.i") + 1).alias("up")
    )
    own = inside.select(F.col("child").alias("node"), F.col("t").alias("target"), F.col("w").alias("depth"), F.col("up").alias("path"))
    far = rows.withColumnRenamed("target", "child").join(inside, "child").select(
        "node", F.col("t").alias("target"), (F.col("depth") + F.col("w")).alias("depth"), F.concat("path", "up").alias("path")
    )
    both = rows.unionByName(own).unionByName(far)
    return both.groupBy("node", "target").agg(F.min(F.struct("depth", "path")).alias("b")).select("node", "target", "b.depth", "b.path")


def _lower(lost: DataFrame, rows: DataFrame, flags: DataFrame, looped: DataFrame | None, edges: DataFrame, every: bool, paths: bool):
    """Add the rows and flags of the children in lost, whose parents are already solved."""
    state = lost.join(flags.select(F.col("node").alias("parent"), "state"), "parent", "left_semi").select(F.col("child").alias("node"), F.lit(2).alias("state"), F.lit(None).cast("string").alias("scc"))
    if looped is not None:
        mine = looped.join(lost.select(F.col("child").alias("node")), "node", "left_semi")
        state = state.unionByName(mine.select("node", F.lit(1).alias("state"), "scc"))
    flags = flags.unionByName(state.groupBy("node").agg(F.min("state").alias("state"), F.max("scc").alias("scc")))
    if every is None:
        return rows, flags
    none = F.array().cast("array<string>")
    roots = edges.select("parent").distinct().join(edges.select(F.col("child").alias("parent")), "parent", "left_anti")
    tail = F.concat("via", F.array("parent"), F.coalesce("path", none)) if paths else none
    below = lost.join(rows.withColumnRenamed("node", "parent"), "parent").select(
        F.col("child").alias("node"), "target", (F.col("w") + F.col("depth")).alias("depth"), tail.alias("path")
    )
    if every:
        spots = F.transform(F.concat("via", F.array("parent")), lambda x, i: F.struct(x.alias("t"), i.alias("i")))
        near = lost.select("child", F.concat("via", F.array("parent")).alias("all"), F.explode(spots).alias("s")).select(
            F.col("child").alias("node"),
            F.col("s.t").alias("target"),
            (F.col("s.i") + 1).cast("int").alias("depth"),
            (F.slice("all", 1, F.col("s.i") + 1) if paths else none).alias("path"),
        )
    else:
        near = lost.join(roots, "parent", "left_semi").select(
            F.col("child").alias("node"), F.col("parent").alias("target"), F.col("w").cast("int").alias("depth"),
            (F.concat("via", F.array("parent")) if paths else none).alias("path"),
        )
    new = (
        below.unionByName(near).groupBy("node", "target").agg(F.min(F.struct("depth", "path")).alias("b"))
        .select("node", "target", "b.depth", "b.path")
    )
    return rows.select("node", "target", "depth", "path").unionByName(new), flags


def resolve_hierarchy(
    links: DataFrame,
    parent: str = "parent_id",
    child: str = "child_id",
    every_ancestor: bool | None = False,
    paths: bool = False,
    max_local_edges: int = MAX_LOCAL_EDGES,
) -> tuple[DataFrame, DataFrame]:
    """Solve a parent-child table: (rows, flags).

    rows (node, target, depth, path): for each node with a parent, each root above it, or each ancestor if
    every_ancestor, with the smallest number of steps and, if paths, the nodes on the way up, target last; of several
    shortest ways the one whose ids come first in order. None for every_ancestor asks for the flags alone. flags (node, state, scc): state 1 for nodes on a cycle
    (scc: the id of one of them, the same for all), 2 for nodes below one.

    Rows with a null id are ignored, repeated pairs count once, other columns are not read whatever their names. An
    empty table gives empty results. A node that is its own parent is a cycle; a node on a cycle is its own ancestor.
    """
    none = F.array().cast("array<string>")
    edges = cut(
        links.select(F.col(parent).cast("string").alias("parent"), F.col(child).cast("string").alias("child"))
        .where("parent is not null and child is not null")
        .distinct()
        .select("child", "parent", F.lit(1).alias("w"), none.alias("via"))
    )
    return _solve(edges, every_ancestor, paths, max_local_edges, 0, 0)


def hierarchy_roots(links: DataFrame, max_local_edges: int = MAX_LOCAL_EDGES, **ids: str) -> DataFrame:
    """(class_id, root_id, depth): roots above each class; root_id '' with -1 on a cycle and -2 below one."""
    rows, flags = resolve_hierarchy(links, max_local_edges=max_local_edges, **ids)
    return rows.select(F.col("node").alias("class_id"), F.col("target").alias("root_id"), "depth").unionByName(
        flags.select(F.col("node").alias("class_id"), F.lit("").alias("root_id"), (-F.col("state")).cast("int").alias("depth"))
    )


def hierarchy_paths(links: DataFrame, max_local_edges: int = MAX_LOCAL_EDGES, **ids: str) -> DataFrame:
    """(class_id, root_id, depth, path): path runs from the root down to the class, ids joined by ' > '."""
    rows, _ = resolve_hierarchy(links, paths=True, max_local_edges=max_local_edges, **ids)
    path = F.array_join(F.concat(F.reverse("path"), F.array("node")), " > ")
    return rows.select(F.col("node").alias("class_id"), F.col("target").alias("root_id"), "depth", path.alias("path"))


def hierarchy_descendants(links: DataFrame, max_local_edges: int = MAX_LOCAL_EDGES, **ids: str) -> DataFrame:
    """(class_id, descendant_id, depth): all classes below each class; a class on a cycle is below itself."""
    rows, _ = resolve_hierarchy(links, every_ancestor=True, max_local_edges=max_local_edges, **ids)
    return rows.select(F.col("target").alias("class_id"), F.col("node").alias("descendant_id"), "depth")
