import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandwork.functions import text as t
from strandwork.operators import callgraph, clones, coverage, extract, graph, ordered, retrieval, routes
from strandwork.sources import files as src


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edges(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "caller_id string, callee_id string")


DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]


def test_bfs_and_paths(spark):
    e = edges(spark, [*DIAMOND, *DIAMOND, ("d", "external::x"), ("d", "a"), ("e", "e"), (None, "q")])
    seeds = spark.createDataFrame([("a",), ("zz",)], "id string")
    assert rows(graph.bfs(e, seeds)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("zz", "zz", 0)]
    assert rows(graph.bfs(e, seeds, "callee_id", "caller_id", 1)) == [("a", "a", 0), ("a", "d", 1), ("zz", "zz", 0)]
    p = graph.simple_paths(e, spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("d",)], "id string"))
    assert rows(p) == [(["a", "b", "d"], 2), (["a", "c", "d"], 2)]
    assert graph.bfs(e.limit(0), seeds.limit(0)).collect() == []


def test_depths_components_cycles(spark):
    e = edges(spark, [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("y", "x"), ("s", "s")])
    assert dict(rows(graph.depths_from_roots(e))) == {"r": 0, "a": 1, "b": 2, "c": 3, "d": 4, "x": -1, "y": -1, "s": -1}
    got = {r["id"]: (r["component"], r["size"], r["self_loop"]) for r in graph.strong_components(e).collect()}
    by_colour = {r["id"]: (r["component"], r["size"], r["self_loop"]) for r in graph.components_by_colour(e, "caller_id", "callee_id").collect()}
    assert got == by_colour
    assert got["b"] == ("a", 3, False) and got["x"] == ("x", 2, False) and got["s"] == ("s", 1, True) and got["d"] == ("d", 1, False)
    assert rows(graph.cycles(e, "caller_id", "callee_id")) == [(["a", "b", "c"], 3), (["s"], 1), (["x", "y"], 2)]


def test_cycles_of_any_length(spark):
    ring = [f"r{i:02d}" for i in (5, 3, 8, 1, 9, 2, 7, 4, 6)]
    # the second ring hangs on a short loop, so a part of its nodes is on no short cycle
    big = [f"b{i}" for i in range(8)]
    e = edges(spark, [*zip(ring, [*ring[1:], ring[0]]), *zip(big, [*big[1:], big[0]]), ("b1", "b0"), ("x", "r05")])
    assert rows(graph.cycles(e, "caller_id", "callee_id")) == sorted([(["r01", "r09", "r02", "r07", "r04", "r06", "r05", "r03", "r08"], 9), (["b0", "b1"], 2), (big, 8)], key=repr)
    assert rows(graph.cycles(e, "caller_id", "callee_id", small=3)) == rows(graph.cycles(e, "caller_id", "callee_id"))


def test_cycles_in_rounds_and_in_one_task(spark):
    r = random.Random(3)
    pairs = [(f"n{r.randrange(14):02d}", f"n{r.randrange(14):02d}") for _ in range(40)]
    e = edges(spark, pairs)
    down = {}
    for a, b in pairs:
        down.setdefault(a, set()).add(b)
    want = set()
    for seed in down:
        ways = [(seed,)]
        for _ in range(14):
            closed = [w for w in ways if seed in down.get(w[-1], ())]
            if closed:
                way = min(closed)
                k = way.index(min(way))
                want.add(way[k:] + way[:k])
                break
            ways = [(*w, x) for w in ways for x in down.get(w[-1], ()) if x not in w]
    for small in (5_000, 0):
        assert {tuple(c["cycle"]) for c in graph.cycles(e, "caller_id", "callee_id", small).collect()} == want


def test_shortest_paths(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("a", "x"), ("x", "y"), ("y", "d"), ("b", "b"), ("d", "e")])
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    got = rows(graph.shortest_paths(e, one("a", "x"), one("e", "a")))
    assert got == sorted([("a", "e", ["a", "b", "d", "e"], 3), ("a", "e", ["a", "c", "d", "e"], 3), ("x", "e", ["x", "y", "d", "e"], 3), ("x", "a", ["x", "y", "d", "a"], 3)], key=repr)
    assert rows(graph.shortest_paths(e, one("a"), one("e"), k=1)) == [("a", "e", ["a", "b", "d", "e"], 3)]
    assert graph.shortest_paths(e, one("a"), one("e"), max_steps=2).collect() == [] and graph.shortest_paths(e.limit(0), one("a"), one("e")).collect() == []


@pytest.mark.parametrize("bound", [100, 0])
def test_betweenness(spark, bound):
    e = spark.createDataFrame([*DIAMOND, ("d", "e")], "source string, target string")
    got = dict(rows(graph.betweenness(e, max_edges=bound)))
    # raw: b and c 1/2 for a-d and 1/2 for a-e; d 1 each for a-e, b-e, c-e
    assert got == {"a": 0.0, "b": pytest.approx(1 / 3), "c": pytest.approx(1 / 3), "d": 1.0, "e": 0.0}


def test_betweenness_of_more_links_than_one_task_had(spark, monkeypatch):
    # a dense graph, whose last levels are searched from the nodes not reached yet, and blocks of sources
    r = random.Random(2)
    pairs = sorted({(f"n{r.randrange(14):02d}", f"n{r.randrange(18):02d}") for _ in range(70)})
    up = {}
    for a, b in pairs:
        if a != b:
            up.setdefault(a, []).append(b)
    want = dict.fromkeys([x for p in pairs for x in p if p[0] != p[1]], 0.0)
    for s in want:
        ways, level = {s: [[s]]}, [s]
        while level:
            nxt = {}
            for v in level:
                for w in up.get(v, ()):
                    if w not in ways:
                        nxt.setdefault(w, []).extend(p + [w] for p in ways[v])
            ways |= nxt
            level = list(nxt)
        for t, found in ways.items():
            for p in found:
                for v in p[1:-1]:
                    want[v] += 1 / len(found)
    top = max(want.values())
    e = spark.createDataFrame(pairs, "source string, target string")
    monkeypatch.setattr(graph, "PAIRS_PER_BLOCK", 200)
    for bound in (1000, 0):
        assert dict(rows(graph.betweenness(e, max_edges=bound))) == {k: pytest.approx(v / top) for k, v in want.items()}


def test_pagerank_and_communities(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "source string, target string")
    r = dict(rows(graph.pagerank(e)))
    assert r["a"] == 1.0 and r["a"] > r["b"] > r["c"]
    two = [(x, y) for g in ("abcd", "wxyz") for x in g for y in g if x < y] + [("d", "w")]
    ids = spark.createDataFrame([(x,) for x in "abcdwxyzq"], "id string")
    c = dict(rows(graph.communities(edges(spark, [*two, ("a", "external::x"), ("w", "external::x")]), ids)))
    assert c["q"] == "q" and len(c) == 9
    assert len({c[x] for x in "abcd"}) == 1 and len({c[x] for x in "wxyz"}) == 1 and c["a"] != c["z"]


def test_inheritance_adjacency(spark):
    calls = edges(spark, [("m", "n")])
    links = spark.createDataFrame([("P", "C"), ("P", "C")], "parent_id string, child_id string")
    methods = spark.createDataFrame([("P", "P.m1"), ("P", "P.m2"), ("C", "C.m1")], "class_id string, id string")
    assert rows(graph.adjacency_with_overrides(calls, links, methods)) == [("P.m1", "C.m1", "inheritance"), ("P.m2", "C.m1", "inheritance"), ("m", "n", "call")]
    assert rows(graph.adjacency_with_overrides(calls, links, methods, 1)) == [("m", "n", "call")]


def test_ordered(spark):
    ts = lambda h: datetime(2025, 1, 1, h)
    left = spark.createDataFrame([(1, "k", ts(1)), (2, "k", ts(2)), (3, "k", ts(20)), (4, "j", ts(1))], "id int, key string, ts timestamp")
    right = spark.createDataFrame([("k", ts(2)), ("k", ts(2)), ("k", ts(19)), ("x", ts(3))], "key string, ts timestamp")
    got = {r["id"]: r["next"] for r in ordered.as_of_forward(left, right, "key", "ts", "next").collect()}
    assert got == {1: ts(2), 2: ts(19), 3: None, 4: None}
    n = ordered.running_count(left, ["key"], "ts", ["id"], F.col("id") != 2, "n")
    assert {r["id"]: r["n"] for r in n.collect()} == {1: 1, 2: 1, 3: 2, 4: 1}


def test_http_edges(spark):
    calls = spark.createDataFrame([(1, "get", "/api/v1/items/${id}"), (2, "GET", "/x/{y}/z"), (3, "POST", "/items/1"), (4, None, "https://h/items/<a>?q=1"), (5, "GET", "/none")], "call_id int, method string, url string")
    r = spark.createDataFrame([(1, "GET", "/items/{id}"), (2, "UNKNOWN", "/x/<a>/z/"), (3, "GET", "/items/:n/more")], "route_id int, method string, path string")
    assert rows(routes.http_edges(calls, r)) == [(1, 1, "path"), (2, 2, "path"), (4, 1, "path")]
    r2 = spark.createDataFrame([(1, "GET", "/x/q/z"), (2, "GET", "/x/:a/z"), (3, "GET", "/y/q/z")], "route_id int, method string, path string")
    assert rows(routes.http_edges(calls.where("call_id = 2"), r2)) == [(2, 2, "exact")]
    assert rows(routes.http_edges(spark.createDataFrame([(9, "GET", "/x/b/z")], calls.schema), r2)) == [(9, 2, "fuzzy")]


def test_scalar_functions(spark):
    one = spark.createDataFrame([("parseHTTPSpec_two", "src/api/users.test.ts", "if (a && b) { return c ? 1 : 2 } // x\n# y")], "name string, path string, code string")
    r = one.select(
        t.kebab("name"), t.pascal("name"), t.slug(F.lit("A b--C!")), t.base_name("path"), t.extension("path"), t.module_of("path"), t.cyclomatic_complexity("code", F.lit("TypeScript")), t.normalise_code("code"),
        t.join_paths(F.lit("/a/"), F.lit("/b")), t.join_paths(F.lit(""), F.lit("")), t.similarity(F.lit("loadUser"), F.lit("load_user")), t.similarity(F.lit("loadUser"), F.lit("loadUserById")), t.redact(F.lit("api_key = 'abcdef123'")),
        t.remote_to_web(F.lit("git@h.org:a/b.git")), t.decision_id(F.lit("s"), F.lit("d"), F.lit("t")), t.line_of("code", F.lit(45)),
    ).first()
    assert tuple(r)[:10] == ("parse-http-spec-two", "ParseHttpSpecTwo", "a-b-c", "users.test.ts", "ts", "api", 4, "if (a && b) { return c ? 1 : 2 }", "/a/b", "/")
    assert tuple(r)[10:14] == (1.0, 0.8, "api_key = [REDACTED]", "https://h.org/a/b") and len(r[14]) == 8
    f = one.select(t.path_flags("path").alias("f"), t.matches_any("path", ["src/**/*.ts"]).alias("g"), t.matches_any("path", ["*.ts"]).alias("h")).first()
    assert f["f"]["is_test"] and f["g"] and not f["h"]
    assert one.select(t.rename_identifiers(F.lit("let a = b + a; return fn(b)"))).first()[0] == "let _v0 = _v1 + _v0; return _v2(_v1)"


def test_clones(spark):
    body = "function {n}({a}) {{\n  // note\n  let total = 0;\n  for (const x of {a}) total += x;\n  return total;\n}}\n"
    u = spark.createDataFrame([(1, body.format(n="f", a="p")), (2, body.format(n="f", a="p").replace("// note", "// other  ")), (3, body.format(n="g", a="q")), (4, body.format(n="h", a="r")), (5, "short"), (6, None)], "id int, code string")
    got = {r["id"]: (r["kind"], r["group_id"]) for r in clones.clone_groups(u, "id", "code").collect()}
    assert got[1] == got[2] and got[1][0] == "exact" and got[3] == got[4] and got[3][0] == "renamed" and set(got) == {1, 2, 3, 4}


def test_clones_of_functions_in_different_files(spark, tmp_path):
    from strandwork.plans import text_queries

    body = "function copied(a) {\n  let total = 0;\n  for (const x of a) total += x * 2;\n  log(total);\n  return total;\n}\n"
    near = "def work(rows):\n    out = []\n    for r in rows:\n        out.append(r + 1)\n        out.append(r - 1)\n        out.append(r * 7)\n        out.append(r / 3)\n    return out\n"
    far = near.replace("    return out", "    log(out)\n    return out")
    texts = [("a.ts", "const one = 1;\nexport " + body), ("b.ts", "// two\nimport { y } from './y';\n" + body + "y();\n"), ("c.py", "import x\n\n" + near + "\n\nx.go()\n"), ("d.py", far), ("e.ts", body.replace("copied", "other").replace("total", "sum")), ("f.ts", body.replace("copied", "third").replace("total", "all")), ("g.md", body), ("h.ts", None)]
    spark.createDataFrame([(i, "r", p, c, "x") for i, (p, c) in enumerate(texts)], "file_id long, repo string, file_path string, content string, language string").write.parquet(str(tmp_path / "source_files.parquet"))
    got = {(r["file_id"], r["name"], r["start_line"], r["end_line"]): (r["kind"], r["group_id"]) for r in text_queries.clones_exact_and_renamed(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == {(0, "copied", 2, 7): "exact", (1, "copied", 3, 8): "exact", (2, "work", 3, 10): "near", (3, "work", 1, 9): "near", (4, "other", 1, 6): "renamed", (5, "third", 1, 6): "renamed"}
    assert len(set(got.values())) == 3


def test_near_groups_by_first_unit(spark):
    w = [f"w{i}(" for i in range(60)]
    line = lambda a: "\n".join([*a, ")", ")", ")"])
    # 1 ~ 2 ~ 3 in a chain, 1 and 3 apart: 2 goes to 1, 3 stays alone and takes 4
    chain = [[str(k + 7 * i) + "(" for k in range(60)] for i in range(3)]
    u = spark.createDataFrame([(i + 1, line(c)) for i, c in enumerate(chain)] + [(4, line(chain[2]) + "+"), (5, line(w)), (6, "x")], "id long, code string")
    pairs, _ = clones.similar_classes(u, "id", "code", 0.7, split=t.words)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(1, 2), (2, 3), (2, 4), (3, 4)}
    got = {r["id"]: r["group_id"] for r in clones.near_groups(u, "id", "code", u.where("id = 0").select("id")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == got[2] != got[3] == got[4]


def test_similar_texts_of_any_script(spark):
    ru = "Устаревший снимок задерживает все входящие вызовы несмотря на прежнее предупреждение сервера и журнала записей в архиве"
    ja = "検討の担当者は見出しを直さない限り鮮度の状態を繰り返します"
    texts = [(1, ru), (2, ru.upper() + "!"), (3, ru + " сегодня"), (4, ja), (5, ja + "。"), (6, ja + "か"), (7, "古いスナップショットは誰も求めていない"), (8, "!!"), (9, "??"), (10, "!!"), (11, "é a b c d e"), (12, "e a b c d é"), (13, ""), (14, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in clones.similar_texts(df, "id", "text").collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 1), 5: (4, 1), 6: (6, 1), 7: (7, 0), 8: (8, 0), 9: (9, 0), 10: (8, 0), 11: (11, 0), 12: (12, 0), 13: (13, 0)}


def test_similar_texts_against_all_pairs(spark):
    import random

    r = random.Random(1)
    vocabulary = [f"w{i:02d}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(40)] for _ in range(6)]
    texts = []
    for i in range(60):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            w[r.randrange(40)] = r.choice(vocabulary)
        texts.append((i, " ".join(w)))
    texts += [(60, ""), (61, None), (62, "w01 w02"), (63, "w02 w01"), (64, "w01 w02 w03")]
    sets = {}
    for i, x in texts:
        if x is not None:
            w = x.split()
            sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset(w)
    cls = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    reps = sorted(set(cls.values()))
    links = dict.fromkeys(reps, 0)
    for a in reps:
        for b in reps:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
    df = spark.createDataFrame(texts, "id int, text string").repartition(4)
    assert {r["id"]: (r["class_id"], r["n_links"]) for r in clones.similar_texts(df, "id", "text").collect()} == {i: (cls[i], links[cls[i]]) for i in sets}
    assert clones.similar_texts(df.limit(0), "id", "text").collect() == []


def test_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, ""), (4, None)], "id int, text string")
    q = spark.createDataFrame([(7, "alpha GAMMA"), (8, "nothing")], "query_id long, query string")
    assert [(r["id"], r["rank"]) for r in retrieval.bm25(docs, "id", "text", q).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    v = spark.createDataFrame([(i, [float(i % 5), float(i // 5)]) for i in range(20)] + [(99, None)], "vec_id long, embedding array<float>")
    got = retrieval.nearest(v, "vec_id", "embedding", v.where("vec_id in (0, 7)"), 3, block=1).collect()
    assert sorted((g["query_id"], g["rank"], g["id"], g["distance"]) for g in got) == [(0, 1, 1, 1.0), (0, 2, 5, 1.0), (0, 3, 6, 2.0), (7, 1, 2, 1.0), (7, 2, 6, 1.0), (7, 3, 8, 1.0)]


def test_unified(spark):
    code = spark.createDataFrame([(1, "f", 2.0), (1, "g", 1.0)], "query_id int, id string, score double")
    spec = spark.createDataFrame([(1, 10, 4.0), (1, 11, 1.0)], "query_id int, id int, score double")
    links = spark.createDataFrame([("g", 10), ("g", 11), ("zz", 10)], "function_id string, spec_id int")
    got = [(r["id"], r["kind"], r["score"]) for r in routes.unified_search(code, spec, links).orderBy("rank").collect()]
    assert got == [("10", "both", 1.3), ("f", "code", 1.0), ("g", "both", 0.9), ("11", "both", 0.55)]


def test_extract(spark):
    js = "import a, { b } from './b.js';\nimport './side';\nconst c = require(\"c\");\nexport const d = process.env.HOME_DIR;\nexport default class E extends F {}\napp.get('/x/:id', h);\nfetch(`/api/y`);\nit('does x', () => {});\n"
    py = "import os\nfrom a.b import c\nX_Y = os.environ['KEY']\ndef f(a):\n    pass\nclass G(H):\n    pass\n@app.get('/z')\ndef z(): pass\n"
    f = spark.createDataFrame([(1, "p/a.js", js), (2, "p/b.py", py), (3, "p/b.ts", "export function q() {}"), (4, "x.js", None), (5, "side.js", "")], "file_id long, file_path string, content string")
    assert rows(extract.imports(f)) == sorted([(1, "import", "./b.js"), (1, "side_effect", "./side"), (1, "require", "c"), (2, "import", "os"), (2, "from", "a.b")], key=repr)
    assert {(r[0], r[2]) for r in extract.exports(f).collect()} == {(1, "d"), (1, "E"), (2, "f"), (2, "G"), (2, "X_Y"), (2, "z"), (3, "q")}
    assert rows(extract.environment(f)) == [("HOME_DIR", 1), ("KEY", 1)]
    assert rows(extract.resolved_imports(f)) == [(1, "./b.js", 3)]
    assert {r["name"] for r in extract.rule_matches(f, extract.ROUTES).collect()} == {"/x/:id", "/z"}
    assert {r["name"] for r in extract.rule_matches(f, extract.HTTP_CALLS).collect()} == {"/api/y"}
    assert {r["name"] for r in extract.rule_matches(f, extract.TESTS).collect()} == {"does x"}
    assert {r["name"] for r in extract.rule_matches(f, extract.PARENTS).collect()} == {"F", "H"}


def test_documents(spark):
    text = "# ADR-007: Keep it\n\n```\n# no heading\n```\n## Context\n### Requirement: Fold\n#### Scenario: One\n"
    d = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")
    assert rows(extract.headings(d))[0] == (1, 0, 1, "ADR-007: Keep it") and extract.headings(d).count() == 4
    assert rows(extract.requirements(d)) == [(1, 2, "requirement", "Fold"), (1, 3, "scenario", "One")]
    assert rows(extract.decision_records(d)) == [(1, 7, "Keep it", 1)]
    long = "\n".join(["x" * 50] * 30 + [""] + ["y" * 50] * 30 + [""] + ["z"])
    c = extract.chunks(spark.createDataFrame([(1, long), (2, "short"), (3, "")], "doc_id long, text string"), max_chars=1000, overlap=2).orderBy("doc_id", "chunk_no").collect()
    one = [r["chunk"].split("\n") for r in c if r["doc_id"] == 1]
    joined = one[0] + [line for part in one[1:] for line in part[2:]]
    assert "\n".join(joined) == long and len(one) == 3 and [r["chunk"] for r in c if r["doc_id"] > 1] == ["short", ""]


def test_changes(spark):
    lines = spark.createDataFrame([("M\ta/service.ts",), ("R090\told.ts\tnew.ts",), ("C50\tx\ty",), ("D\tgone.ts",), ("junk",)], "value string")
    assert rows(src.name_status(lines)) == sorted([("a/service.ts", "modified", None), ("new.ts", "renamed", "old.ts"), ("y", "added", None), ("gone.ts", "deleted", None)], key=repr)
    stat = spark.createDataFrame([("31\t2\ta/service.ts",), ("-\t-\tb.png",), ("1\t0\tsrc/{old => new}/c.ts",), ("1\t1\told.ts => new.ts",)], "value string")
    assert rows(src.numstat(stat)) == [("a/service.ts", 31, 2), ("b.png", 0, 0), ("new.ts", 1, 1), ("src/new/c.ts", 1, 0)]
    diff = "diff --git a/f.ts b/f.ts\n--- a/f.ts\n+++ b/f.ts\n@@ -1,2 +3,4 @@\n ctx\n+export function x() {}\n@@ -9 +12,0 @@\n-gone\ndiff --git a/g b/g\n+++ b/g\n@@ -0,0 +1 @@\n+MAX = 3\n"
    h = src.diff_hunks(spark.createDataFrame([(diff,)], "diff string"))
    assert rows(h.select("path", "start", "end", src.change_kind(F.col("added")))) == [("f.ts", 12, 12, "logic"), ("f.ts", 3, 6, "signature"), ("g", 1, 1, "config")]
    c = src.changed_files(src.name_status(lines), src.numstat(stat))
    mapping = spark.createDataFrame([("d1", "a/service.ts"), ("d1", "gone.ts"), ("d2", "missing.ts"), ("d2", "old.ts")], "domain string, path string")
    existing = spark.createDataFrame([("a/service.ts",), ("new.ts",), ("y",), ("old.ts",), ("gone.ts",)], "path string")
    got = rows(coverage.drift(c, mapping, existing, spark.createDataFrame([("d9",)], "domain string")))
    assert got == sorted([("gap", "d1", "a/service.ts", "error"), ("stale", "d1", "gone.ts", "error"), ("stale", "d2", "old.ts", "warning"), ("uncovered", None, "y", "info"), ("orphaned", "d2", "missing.ts", "warning")], key=repr)


def test_overlaps(spark):
    p = spark.createDataFrame([(1, "f", 10, 2000), (2, "f", 5, 5), (3, None, 1, 2)], "pid int, file string, a int, b int")
    s = spark.createDataFrame([("x", "f", 0, 9), ("y", "f", 9, 1500), ("z", "g", 0, 99)], "id string, file string, s int, e int")
    assert rows(coverage.overlaps(p, s, "file", "a", "b", "s", "e", 64).select("pid", "id", "overlap")) == [(1, "y", 1491), (2, "x", 1)]
    inner = spark.createDataFrame([("out", "f", 0, 100), ("in", "f", 4, 8)], "id string, file string, s int, e int")
    assert rows(coverage.enclosing(p, inner, "file", "a", "s", "e", "id", "pid")) == [(1, "out"), (2, "in")]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    assert rows(coverage.upsert(old, new, ["k"], "v")) == [("a", 1), ("b", 3), ("c", 1)]
    assert rows(coverage.insert_absent(old, new.where("v < 3"), ["k"])) == [("a", 1), ("b", 1), ("c", 1)]
    p = str(tmp_path / "t")
    src.overwrite(old, p)
    src.overwrite(new, p)
    assert rows(src.read_current(spark, p)) == rows(new)


def test_sources(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/api.test.ts").write_text("a\nb")
    (tmp_path / "src/node_modules/x.js").write_text("x")
    (tmp_path / "src/run").write_text("#!/bin/sh\n")
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}))
    (tmp_path / "requirements.txt").write_text("flask>=2\n# c\nnumpy\n")
    (tmp_path / "Cargo.toml").write_text('[package]\nname = "x"\n[dependencies]\nserde = { version = "1.0" }\n[dev-dependencies]\nrand = "0.8"\n')
    (tmp_path / "go.mod").write_text("module m\nrequire github.com/a/b v1.2.3\n")
    w = src.walk(spark, str(tmp_path), content=True)
    got = {r["path"]: r for r in w.collect()}
    assert set(got) == {"src/api.test.ts", "src/run", "package.json", "requirements.txt", "Cargo.toml", "go.mod"}
    assert got["src/api.test.ts"]["lines"] == 2 and got["src/api.test.ts"]["is_test"] and got["src/run"]["is_entry_point"] and got["package.json"]["is_config"]
    assert {(r["ecosystem"], r["name"], r["version"], r["is_dev"]) for r in src.packages(w).collect()} == {("npm", "a", "^1", False), ("npm", "b", "2", True), ("pip", "flask", ">=2", False), ("pip", "numpy", "", False), ("cargo", "serde", "1.0", False), ("cargo", "rand", "0.8", True), ("go", "github.com/a/b", "v1.2.3", False)}
    env = spark.createDataFrame([("a/.env.example", "# the key\nKEY=\nHOST=x\n")], "path string, content string")
    assert {(r["name"], r["has_default"], r["description"]) for r in src.settings(env).collect()} == {("KEY", False, "the key"), ("HOST", True, None)}
    assert src.fingerprint(w).first()["n_files"] == 6
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert rows(src.read_lines(spark, str(tmp_path / "log.jsonl"), "a int")) == [(1,), (2,)]


def test_risk(spark):
    d = spark.createDataFrame([(10, 100, "logic", 0, 0.0, 0.0, 0.0), (300, 100, "signature", 9, 1.0, 20.0, 2.0)], "changed int, length int, kind string, fan_in int, test_weight double, transitive double, boundary double")
    assert [r["risk"] for r in coverage.change_risk(d).orderBy("changed").collect()] == [0.0, 20.43]
    nodes = spark.createDataFrame([("a", "A", "f", 0), ("b", "B", "f", 0), ("x", "X", "g", 1)], "id string, name string, file_path string, is_external int")
    e = edges(spark, [("a", "b"), ("a", "x"), ("a", "b")])
    got = {r["id"]: (r["fan_in"], r["fan_out"], r["upstream"], r["downstream"], r["risk"], r["level"]) for r in graph.impact(nodes, e, nodes.select("id")).collect()}
    assert got["a"] == (0, 2, 0, 2, 7, "low") and got["b"] == (1, 0, 1, 0, 6, "low")
    assert callgraph.graph_statistics(nodes, e).first()["n_entry_points"] == 1


def test_transitive_scores(spark):
    e = spark.createDataFrame([("a", "b", "await"), ("a", "b", "direct"), ("c", "a", "method"), ("d", "a", None), ("b", "d", "direct"), ("z", None, None)], "caller_id string, callee_id string, call_type string").withColumn("kind", F.lit(None).cast("string"))
    got = dict(rows(coverage.transitive_scores(e, spark.createDataFrame([("b",), ("c",), (None,)], "id string"))))
    # b: a by await at 1, then c by method and d by an unknown call at 2, then b itself at 3
    assert got == {"b": pytest.approx(1.0 + (0.6 + 0.5) / 4 + 0.7 / 9)}
    many = spark.createDataFrame([(f"c{i}", "hub", "await", None) for i in range(12)], "caller_id string, callee_id string, call_type string, kind string")
    assert dict(rows(coverage.transitive_scores(many, spark.createDataFrame([("hub",)], "id string")))) == {"hub": 10.0}
    nodes = spark.createDataFrame([("h", 1, "http"), ("f", 1, "filesystem"), ("i", 0, None)], "id string, is_external int, external_kind string")
    b = spark.createDataFrame([("a", "h", None), ("b", "f", "calls"), ("c", "i", None)], "caller_id string, callee_id string, kind string")
    assert dict(rows(coverage.boundary_scores(b, nodes))) == {"a": 1.0, "b": pytest.approx(1 / 3)}


def test_tested_by(spark):
    e = spark.createDataFrame([("t/a.test.ts", "src/m.ts::run"), ("t/a.test.ts", "src/m.ts::run"), ("src/o.ts", "src/m.ts::stop"), (None, "src/m.ts::run")], "caller_file string, callee_id string")
    n = spark.createDataFrame([("src/m.ts::run", "run", "src/m.ts", 0), ("src/m.ts::stop", "stop", "src/m.ts", 0), ("t/a.test.ts::help", "help", "t/a.test.ts", 0)], "id string, name string, file_path string, is_external int")
    i = spark.createDataFrame([("t/a.test.ts", "src/m.ts", "run"), ("t/a.test.ts", "src/m.ts", "stop"), ("src/o.ts", "src/m.ts", "run")], "test_file string, target_path string, name string")
    got = callgraph.tested_by(e, n, i)
    assert rows(got) == [("src/m.ts::run", "t/a.test.ts", "called"), ("src/m.ts::stop", "t/a.test.ts", "import")]
    assert dict(rows(coverage.test_weights(got))) == {"src/m.ts::run": 1.0, "src/m.ts::stop": 0.3}


def test_components_and_far_imports(spark):
    body = "\n".join(f"  const a{i} = {i};" for i in range(200))
    text = f"export function Long(p: P) {{\n{body}\n  return (\n    <b/>\n  );\n}}\nfunction Short() {{ return <i/>; }}\nfunction Plain() {{\n  return 1;\n}}\n@Component({{ a: 1 }})\nexport class Box {{}}\n"
    up = "/".join(["a"] * 12)
    f = spark.createDataFrame([(1, "x/view.tsx", text), (2, f"{up}/m.ts", "import { x } from '" + "../" * 12 + "b.js'\n"), (3, "b.ts", "export const x = 1"), (4, None, None)], "file_id long, file_path string, content string")
    assert rows(extract.components(f)) == [(1, "angular", "Box"), (1, "react", "Long"), (1, "react", "Short")]
    assert rows(extract.resolved_imports(f)) == [(2, "../" * 12 + "b.js", 3)]


def test_products(spark):
    from strandwork.operators import products

    f = spark.createDataFrame([("src/auth/login.ts",), ("src/auth/user-store.ts",), ("lib/user-view.tsx",), ("x/auth-core.ts",), ("modules/a/b.go",), (None,)], "file_path string")
    assert {(r["domain"], r["file_path"]) for r in products.inferred_domains(f).collect()} == {("auth", "src/auth/login.ts"), ("auth", "src/auth/user-store.ts"), ("user", "src/auth/user-store.ts"), ("user", "lib/user-view.tsx")}
    dm = spark.createDataFrame([("auth",), ("Auth-Core",), ("user",)], "domain string")
    assert dict(rows(products.known_domains(f, dm))) == {"src/auth/login.ts": "auth", "src/auth/user-store.ts": "auth", "lib/user-view.tsx": "user", "x/auth-core.ts": "Auth-Core"}
    assert products.architecture_pattern(f).first()[0] == "monolith" and products.architecture_pattern(f.limit(0)).first()[0] == "monolith"
    one = spark.createDataFrame([("function f(a: Map<string, [x, y]>, cb: (u, v) => void)", "axios.get")], "s string, n string")
    r = one.select(products.arity(F.col("s")), products.external_kind(F.col("n")), products.external_kind(F.lit("res.send")), products.external_kind(F.lit("foo")), products.search_depth(F.lit(400)), products.arity(F.lit("const x"))).first()
    assert tuple(r) == (2, "http", "stdlib", "unknown", 2, None)


def test_other_languages(spark):
    code = [
        (1, "a.rs", "use std::fmt;\nmod deck;\npub struct Deck<T> {\n}\nimpl Deck {\n    pub async fn show(&self) -> u8 {\n    }\n}\npub fn run() {\n}\n"), (2, "a.rb", "require 'json'\nrequire_relative \"box\"\nmodule Store\n  class Box < Base\n    def put(x)\n    end\n  end\nend\n"),
        (3, "a.cpp", "#include <vector>\n#include \"far.h\"\nclass Ring : public Base {\n};\nint Ring::at(int i) const {\n}\n"), (4, "a.swift", "import Foundation\npublic struct Feed {\n  func load(_ n: Int) async throws -> [Int] {\n  }\n}\n"),
    ]
    f = spark.createDataFrame(code, "file_id long, file_path string, content string")
    assert rows(extract.imports(f)) == sorted([(1, "mod", "deck"), (1, "use", "std::fmt"), (2, "require", "box"), (2, "require", "json"), (3, "include", "far.h"), (3, "system", "vector"), (4, "import", "Foundation")], key=repr)
    assert rows(extract.exports(f)) == sorted([(1, "function", "run"), (1, "type", "Deck"), (2, "class", "Box"), (2, "class", "Store"), (4, "declaration", "Feed")], key=repr)
    assert rows(extract.declarations(f)) == sorted([
        (1, "function", "pub async fn show(&self) -> u8"), (1, "function", "pub fn run()"), (1, "type", "impl Deck"), (1, "type", "pub struct Deck<T>"), (2, "class", "class Box < Base"), (2, "class", "module Store"), (2, "method", "def put(x)"),
        (3, "function", "int Ring::at(int i) const"), (3, "type", "class Ring : public Base"), (4, "function", "func load(_ n: Int) async throws -> [Int]"), (4, "type", "public struct Feed"),
    ], key=repr)


def test_imported_names_and_packages(spark):
    code = [
        (1, "a/x.ts", "import { a, b as c,\n  type D } from './m.js'\nimport E, { f } from \"n\"\nimport g from 'o'\n// import { no } from 'p'\n"), (2, "src/org/A.java", "package org.one;\nimport org.two.B;\nimport org.two.*;\nimport static java.util.List;\n"),
        (3, "lib/B.java", "/* x */\npackage org.two;\npublic class B {}\n"), (4, "z.go", "package z\n"), (5, "e.java", ""), (6, None, None),
    ]
    f = spark.createDataFrame(code, "file_id long, file_path string, content string")
    assert rows(extract.imported_names(f)) == sorted([(1, "./m.js", "a", "a"), (1, "./m.js", "b", "c"), (1, "./m.js", "D", "D"), (1, "n", "f", "f")], key=repr)
    assert rows(extract.declared_packages(f)) == [(2, "src/org/A.java", "org.one"), (3, "lib/B.java", "org.two"), (4, "z.go", "z")]
    assert rows(extract.resolved_java_imports(f)) == [(2, "org.two.B", 3)]
