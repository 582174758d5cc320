import random

import pytest

from strandwork.operators import hierarchy
from strandwork.operators.hierarchy import hierarchy_descendants, hierarchy_paths, hierarchy_roots

SCHEMA = "parent_id string, child_id string, child string, w int, path string"


def brute(pairs):
    """(roots rows, path rows, descendant rows) by breadth-first search upwards from every class."""
    up = {}
    for p, c in pairs:
        if p is not None and c is not None:
            up.setdefault(c, set()).add(p)
    roots, paths, down = set(), set(), set()
    above = {}
    for v in up:
        best, front, d = {}, {v: (v,)}, 0
        while front:
            d += 1
            nxt = {}
            for u, way in front.items():
                for p in up.get(u, ()):
                    new = (*way, p)
                    if p not in best and (p not in nxt or new < nxt[p]):
                        nxt[p] = new
            for p, way in nxt.items():
                best[p] = (d, way)
            front = nxt
        above[v] = best
        for p, (k, way) in best.items():
            down.add((p, v, k))
            if p not in up:
                roots.add((v, p, k))
                paths.add((v, p, k, " > ".join(reversed(way))))
    loops = {v for v in up if v in above[v]}
    for v in up:
        if v in loops:
            roots.add((v, "", -1))
        elif loops & set(above[v]):
            roots.add((v, "", -2))
    return roots, paths, down


def rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def sample(seed):
    r = random.Random(seed)
    pairs = []
    for k in range(3):
        line = [f"line{k}-{i:03d}" for i in range(60)]
        pairs += list(zip(line, line[1:]))
        r.shuffle(pairs)
    pairs += [("wide", f"w{i}") for i in range(80)] + [("line0-020", "w3"), ("line1-030", "w3"), ("w3", "below-w3")]
    names = [f"n{i:02d}" for i in range(60)]
    pairs += [(names[r.randrange(i)], names[i]) for i in range(1, 60)] + [(r.choice(names[:30]), r.choice(names[30:])) for _ in range(25)]
    ring = [f"ring{i}" for i in range(9)]
    pairs += [(ring[i], ring[(i + 1) % 9]) for i in range(9)] + [("ring4", "under"), ("under", "under2"), ("n05", "ring2"), ("self", "self"), ("self", "s2")]
    pairs += [("a", "b"), ("b", "a"), ("root", "a"), ("b", "c"), ("c", "d"), ("d", "b"), (None, "x"), ("x", None), ("line0-059", "line0-030")]
    return pairs + pairs[:40]


@pytest.mark.parametrize(("bound", "per_partition"), [(100_000, 100_000), (150, 80)])
def test_hierarchy_against_breadth_first(spark, monkeypatch, bound, per_partition):
    # few edges a partition: fragments end in the midst of chains and loops
    monkeypatch.setattr(hierarchy, "ROWS_PER_PARTITION", per_partition)
    pairs = sample(bound)
    df = spark.createDataFrame([(p, c, "zz", 5, "q") for p, c in pairs], SCHEMA).repartition(5)
    roots, paths, down = brute(pairs)
    assert rows(hierarchy_roots(df, max_local_edges=bound)) == roots
    assert rows(hierarchy_paths(df, max_local_edges=bound)) == paths
    assert rows(hierarchy_descendants(df, max_local_edges=bound)) == down


def test_quotient_that_does_not_shrink(spark):
    # every node has two parents and sits on a cycle: nothing to rake or contract
    n = 12
    pairs = [(f"k{i:02d}", f"k{(i + s) % n:02d}") for i in range(n) for s in (1, 5)] + [("top", "k00")]
    df = spark.createDataFrame([(p, c) for p, c in pairs], "parent_id string, child_id string")
    roots, paths, down = brute(pairs)
    assert rows(hierarchy_roots(df, max_local_edges=12)) == roots
    assert rows(hierarchy_descendants(df, max_local_edges=12)) == down


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(None, "a", "b", 1, "c"), ("a", None, "b", 1, "c")], SCHEMA)
    for df in (empty, nulls):
        assert rows(hierarchy_roots(df)) == set()
        assert rows(hierarchy_paths(df)) == set()
        assert rows(hierarchy_descendants(df)) == set()


def test_cycles_over_nodes_that_another_fragment_ends_at(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "ROWS_PER_PARTITION", 8)
    r = random.Random(5)
    # rings with a node of two parents each, and chains that end at any of a ring's nodes
    pairs = []
    for k in range(4):
        ring = [f"r{k}-{i:02d}" for i in range(24)]
        pairs += list(zip(ring, ring[1:] + ring[:1])) + [(f"r{k}-05", f"r{k}-00")]
        for j in range(8):
            line = [r.choice(ring), *(f"t{k}-{j}-{i}" for i in range(5))]
            pairs += list(zip(line, line[1:]))
    up = {}
    for p, c in pairs:
        up.setdefault(c, set()).add(p)
    want = {c: 1 if c.startswith("r") else 2 for c in up}
    links = spark.createDataFrame(pairs, "parent_id string, child_id string")
    _, flags = hierarchy.resolve_hierarchy(links, every_ancestor=None, max_local_edges=40)
    got = flags.collect()
    assert len(got) == len(want)
    assert {f["node"]: f["state"] for f in got} == want
    assert len({f["scc"] for f in got if f["state"] == 1}) == 4
