"""Queries over the call graph and the inheritance graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions.text import TEST_PATH
from strandwork.operators import callgraph as c
from strandwork.operators import graph as g
from strandwork.operators.hierarchy import resolve_hierarchy
from strandwork.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _ne(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "nodes"), table(spark, d, "edges")


_DEG = """
WITH p AS (SELECT DISTINCT caller_id, callee_id FROM edges WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL),
fi AS (SELECT callee_id AS id, count(*) AS fan_in FROM p GROUP BY 1), fo AS (SELECT caller_id AS id, count(*) AS fan_out FROM p GROUP BY 1),
d AS (SELECT n.* EXCLUDE (fan_in, fan_out), coalesce(fi.fan_in, 0) AS fan_in, coalesce(fo.fan_out, 0) AS fan_out FROM nodes n LEFT JOIN fi ON fi.id = n.id LEFT JOIN fo ON fo.id = n.id)
"""
_FILES = """
WITH p AS (SELECT DISTINCT caller_id, callee_id, caller_file AS source, callee_file AS target FROM edges WHERE caller_file <> callee_file),
l AS (SELECT source, target, count(*) AS n_calls FROM p GROUP BY 1, 2)
"""


@query(_DEG + "SELECT id, fan_in, fan_out FROM d")
def graph_degrees(spark, d):
    return c.degrees(*_ne(spark, d))


@query(_DEG + "SELECT id, name, fan_in, fan_out FROM d WHERE is_external = 0 AND fan_in >= 5")
def graph_hubs(spark, d):
    return c.hubs(*_ne(spark, d))


@query(_DEG + "SELECT id, name, fan_in FROM d WHERE is_external = 0 ORDER BY fan_in DESC, id LIMIT 20")
def graph_top_hubs(spark, d):
    return c.with_degrees(*_ne(spark, d)).where("is_external = 0").select("id", "name", "fan_in").orderBy(F.desc("fan_in"), "id").limit(20)


@query(_DEG + "SELECT id, name, fan_out FROM d WHERE is_external = 0 AND fan_in = 0")
def graph_entry_points(spark, d):
    return c.entry_points(*_ne(spark, d))


@query(_DEG + "SELECT id, name, file_path, fan_in FROM d WHERE is_external = 0 AND fan_out = 0 AND NOT coalesce(regexp_matches(file_path, '(?i)(^|/)(tests?|__tests__)/|\\.(test|spec)\\.'), false)")
def graph_leaf_functions(spark, d):
    return c.leaf_functions(*_ne(spark, d))


@query(_DEG + "SELECT id, name, fan_in, fan_out FROM d WHERE is_external = 0 AND fan_in BETWEEN 1 AND 2 AND fan_out <= 3")
def graph_low_risk_candidates(spark, d):
    return c.low_risk_candidates(*_ne(spark, d))


_LAYER_CASE = "CASE list_extract(list_filter(string_split({0}, '/'), lambda x: x IN (" + ", ".join(f"'{k}'" for k in c.LAYERS) + ")), 1) "
_RANK = "".join(f"WHEN '{k}' THEN {v} " for k, v in c.LAYERS.items())
_SEG = "list_extract(list_filter(string_split({0}, '/'), lambda x: x IN (" + ", ".join(f"'{k}'" for k in c.LAYERS) + ")), 1)"
_VIOL = f"""v AS (
  SELECT DISTINCT caller_id, callee_id, caller_file, callee_file, {_SEG.format('caller_file')} AS caller_layer, {_SEG.format('callee_file')} AS callee_layer FROM edges
  WHERE {_LAYER_CASE.format('caller_file')} {_RANK} END > {_LAYER_CASE.format('callee_file')} {_RANK} END)
"""


@query(f"WITH {_VIOL} SELECT * FROM v")
def graph_layer_violations(spark, d):
    return c.layer_violations(table(spark, d, "edges"))


@query(
    _DEG + f""", {_VIOL}, b AS (SELECT DISTINCT unnest([caller_file, callee_file]) AS f FROM v),
s AS (SELECT id, fan_in, fan_out, 3.0 * fan_in + 1.5 * fan_out + CASE WHEN file_path IN (SELECT f FROM b) THEN 10.0 ELSE 0.0 END AS criticality FROM d WHERE is_external = 0 AND fan_in >= 5),
t AS (SELECT *, CAST(greatest(0, floor(100 - least(100.0, criticality) + 0.5)) AS INTEGER) AS stability FROM s)
SELECT id, fan_in, fan_out, CAST(criticality AS DOUBLE) AS criticality, stability, CASE WHEN stability < 30 THEN 'extract interface first' WHEN stability < 60 THEN 'split responsibilities' ELSE 'refactor directly' END AS approach FROM t"""
)
def graph_critical_hubs(spark, d):
    n, e = _ne(spark, d)
    return c.critical_hubs(n, e, c.layer_violations(e))


@query(_DEG + "SELECT id, name, fan_out FROM d WHERE is_external = 0 AND fan_out >= 8")
def graph_god_functions(spark, d):
    return c.god_functions(*_ne(spark, d))


@query(
    _DEG + """SELECT count(*) AS n_nodes, CAST(sum(fan_out) AS BIGINT) AS n_edges, CAST(sum(CASE WHEN fan_in >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_hubs,
CAST(sum(CASE WHEN fan_in = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_entry_points, round(avg(fan_in), 6) AS avg_fan_in, round(avg(fan_out), 6) AS avg_fan_out,
round(CAST(sum(fan_out) AS DOUBLE) / (count(*) * (count(*) - 1)), 9) AS density FROM d WHERE is_external = 0"""
)
def graph_statistics(spark, d):
    return c.graph_statistics(*_ne(spark, d))


@query("""SELECT callee_id AS id, list_extract(string_split(callee_id, '::'), -1) AS name, count(DISTINCT caller_id) AS n_callers FROM edges
WHERE callee_id IS NOT NULL AND caller_id IS NOT NULL AND callee_id NOT IN (SELECT id FROM nodes) GROUP BY 1, 2""")
def graph_external_nodes(spark, d):
    return c.external_nodes(*_ne(spark, d))


@query(_DEG + """SELECT file_path, coalesce(class_name, list_extract(string_split(file_path, '/'), -1)) AS class_name, class_name IS NULL AS is_module, count(*) AS n_methods,
CAST(sum(fan_in) AS BIGINT) AS fan_in, CAST(sum(fan_out) AS BIGINT) AS fan_out FROM d WHERE is_external = 0 GROUP BY 1, 2, 3""")
def graph_class_nodes(spark, d):
    return c.class_nodes(*_ne(spark, d))


@query("""SELECT DISTINCT e.edge_id, e.caller_id, e.callee_id FROM edges e WHERE e.callee_id IN (SELECT id FROM nodes WHERE is_hub = 1)""")
def graph_callers_of_hubs(spark, d):
    n, e = _ne(spark, d)
    return c.callers_of(e, n.where("is_hub = 1")).select("edge_id", "caller_id", "callee_id").distinct()


@query("""SELECT DISTINCT e.edge_id, e.caller_id, e.callee_id FROM edges e WHERE e.caller_id IN (SELECT id FROM nodes WHERE is_entry_point = 1)""")
def graph_callees_of_entry_points(spark, d):
    n, e = _ne(spark, d)
    return c.callees_of(e, n.where("is_entry_point = 1")).select("edge_id", "caller_id", "callee_id").distinct()


_LOG = "packages/common-base/src/log/writer.ts"


@query(f"""SELECT edge_id, direction FROM (SELECT DISTINCT edge_id, 'out' AS direction FROM edges WHERE caller_file = '{_LOG}' UNION ALL SELECT DISTINCT edge_id, 'in' FROM edges WHERE callee_file = '{_LOG}') t""")
def graph_edges_of_file(spark, d):
    return c.edges_of_file(table(spark, d, "edges"), _LOG).select("edge_id", "direction").distinct()


@query("SELECT DISTINCT callee_file, caller_file FROM edges WHERE callee_file <> caller_file")
def graph_caller_files(spark, d):
    return c.caller_files(table(spark, d, "edges"))


@query("SELECT DISTINCT id, name, file_path FROM nodes WHERE is_external = 0 AND contains(lower(name), 'prune') ORDER BY name, id LIMIT 50")
def graph_search_names(spark, d):
    return c.search_names(table(spark, d, "nodes"), "prune")


@query("SELECT id, name, file_path FROM nodes WHERE id = 'packages/common-base/src/log/writer.ts::writeRecord'")
def graph_node_lookup(spark, d):
    return table(spark, d, "nodes").where(F.col("id") == "packages/common-base/src/log/writer.ts::writeRecord").select("id", "name", "file_path")


@query(_FILES + "SELECT * FROM l")
def file_edges(spark, d):
    return c.file_edges(table(spark, d, "edges"))


@query(_FILES + """SELECT file, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM
(SELECT target AS file, 1 AS i, 0 AS o FROM l UNION ALL SELECT source, 0, 1 FROM l) t GROUP BY file""")
def file_degrees(spark, d):
    return c.file_degrees(c.file_edges(table(spark, d, "edges")))


@query(_FILES + """, e AS (SELECT regexp_replace(source, '/[^/]*$', '') AS s, regexp_replace(target, '/[^/]*$', '') AS t FROM l),
f AS (SELECT source AS f FROM l UNION SELECT target FROM l), z AS (SELECT regexp_replace(f, '/[^/]*$', '') AS directory, count(*) AS n_files FROM f GROUP BY 1 HAVING count(*) >= 2),
b AS (SELECT unnest(list_distinct([s, t])) AS directory, CASE WHEN s = t THEN 1 ELSE 0 END AS inn FROM e),
k AS (SELECT directory, CAST(sum(inn) AS BIGINT) AS i, CAST(sum(1 - inn) AS BIGINT) AS x FROM b GROUP BY 1)
SELECT z.directory, n_files, coalesce(i, 0) AS internal_edges, coalesce(x, 0) AS external_edges, round(CAST(coalesce(i, 0) AS DOUBLE) / (n_files * (n_files - 1)), 6) AS cohesion,
round(CASE WHEN coalesce(i + x, 0) = 0 THEN 0.0 ELSE CAST(x AS DOUBLE) / (i + x) END, 6) AS coupling FROM z LEFT JOIN k ON k.directory = z.directory""")
def file_clusters(spark, d):
    return c.directory_clusters(c.file_edges(table(spark, d, "edges")))


@query(_FILES + """SELECT list_extract(string_split(source, '/'), 4) AS domain, list_extract(string_split(target, '/'), 4) AS depends_on, count(*) AS n_links FROM l
WHERE list_extract(string_split(source, '/'), 4) <> list_extract(string_split(target, '/'), 4) GROUP BY 1, 2""")
def domain_dependencies(spark, d):
    return c.cross_domain_dependencies(c.file_edges(table(spark, d, "edges")))


@query(_FILES + """, d AS (SELECT file, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT target AS file, 1 AS i, 0 AS o FROM l UNION ALL SELECT source, 0, 1 FROM l) t GROUP BY file),
k AS (SELECT *, CASE WHEN out_degree = 0 THEN 'leaf' WHEN in_degree = 0 THEN 'root' ELSE 'inner' END AS kind FROM d)
SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY in_degree DESC, file) AS INTEGER) AS rank FROM k""")
def file_rankings(spark, d):
    return c.node_rankings(c.file_edges(table(spark, d, "edges")))


def _seeds(spark, d, n=10):
    return graph_top_hubs(spark, d).orderBy(F.desc("fan_in"), "id").limit(n).select("id")


_SEEDS = _DEG.replace("WITH", "WITH RECURSIVE", 1) + ", s AS (SELECT id FROM d WHERE is_external = 0 ORDER BY fan_in DESC, id LIMIT 10), q AS (SELECT DISTINCT caller_id, callee_id FROM p WHERE caller_id <> callee_id)"
_UP = "up AS (SELECT id AS seed, id, 0 AS depth FROM s UNION SELECT up.seed, q.caller_id, up.depth + 1 FROM up JOIN q ON q.callee_id = up.id WHERE up.depth < {0} AND NOT starts_with(q.caller_id, 'external::'))"
_DOWN = "down AS (SELECT id AS seed, id, 0 AS depth FROM s UNION SELECT down.seed, q.callee_id, down.depth + 1 FROM down JOIN q ON q.caller_id = down.id WHERE down.depth < {0} AND NOT starts_with(q.callee_id, 'external::'))"


@query(f"{_SEEDS}, {_UP.format(3)} SELECT seed, id, min(depth) AS depth FROM up GROUP BY 1, 2")
def graph_bfs_up(spark, d):
    return g.bfs(table(spark, d, "edges"), _seeds(spark, d), "callee_id", "caller_id", 3)


@query(f"{_SEEDS}, {_DOWN.format(4)} SELECT seed, id, min(depth) AS depth FROM down GROUP BY 1, 2")
def graph_bfs_down(spark, d):
    return g.bfs(table(spark, d, "edges"), _seeds(spark, d), max_depth=4)


@query(f"""{_SEEDS}, {_DOWN.format(2)}, k AS (SELECT DISTINCT id FROM down)
SELECT DISTINCT e.caller_id, e.callee_id FROM edges e JOIN k a ON a.id = e.caller_id JOIN k b ON b.id = e.callee_id""")
def graph_subgraph(spark, d):
    e = table(spark, d, "edges")
    ids = g.bfs(e, _seeds(spark, d), max_depth=2).select("id").distinct()
    pairs = c.call_pairs(e)
    return pairs.join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi").select("caller_id", "callee_id")


@query(f"""{_SEEDS}, {_UP.format(3)}, {_DOWN.format(3)},
u AS (SELECT seed, count(DISTINCT id) AS n FROM up WHERE id <> seed GROUP BY 1), w AS (SELECT seed, count(DISTINCT id) AS n FROM down WHERE id <> seed GROUP BY 1),
z AS (SELECT d.id, fan_in, fan_out, coalesce(u.n, 0) AS upstream, coalesce(w.n, 0) AS downstream FROM d JOIN s ON s.id = d.id LEFT JOIN u ON u.seed = d.id LEFT JOIN w ON w.seed = d.id),
r AS (SELECT *, upstream + downstream AS blast, floor(4 * fan_in + 2 * fan_out + CASE WHEN fan_in >= 5 THEN 20 ELSE 0 END + 1.5 * (upstream + downstream) + 0.5) AS raw FROM z)
SELECT id, fan_in, fan_out, upstream, downstream, blast, CAST(least(100, raw) AS INTEGER) AS risk, CASE WHEN raw <= 20 THEN 'low' WHEN raw <= 45 THEN 'medium' WHEN raw <= 70 THEN 'high' ELSE 'critical' END AS level FROM r""")
def graph_impact(spark, d):
    n, e = _ne(spark, d)
    return g.impact(n, e, _seeds(spark, d))


@query(f"""{_SEEDS}, a AS (SELECT DISTINCT id FROM nodes WHERE is_entry_point = 1 AND is_external = 0),
b AS (SELECT id AS target, id, 0 AS depth FROM s UNION SELECT b.target, q.caller_id, b.depth + 1 FROM b JOIN q ON q.callee_id = b.id WHERE b.depth < 6), m AS (SELECT target, id, min(depth) AS depth FROM b GROUP BY 1, 2),
w AS (SELECT target, id, [id] AS path, 0 AS depth FROM s UNION ALL SELECT * FROM (SELECT target, id, path, depth FROM (SELECT w.target, q.caller_id AS id, list_prepend(q.caller_id, w.path) AS path, w.depth + 1 AS depth,
  row_number() OVER (PARTITION BY w.target, q.caller_id ORDER BY list_prepend(q.caller_id, w.path)) AS i FROM w JOIN q ON q.callee_id = w.id JOIN m ON m.target = w.target AND m.id = q.caller_id AND m.depth = w.depth + 1) t WHERE i <= 10) u)
SELECT id AS source, target, array_to_string(path, ' > ') AS path, depth AS length FROM w WHERE depth > 0 AND id IN (SELECT id FROM a)""".replace("id AS target, id, 0 AS depth FROM s", "id AS target, id, 0 AS depth FROM s").replace("SELECT target, id, [id] AS path", "SELECT id AS target, id, [id] AS path"))
def graph_trace_paths(spark, d):
    """From entry points to the ten most called functions: of each pair the ten first shortest ways of at most six steps."""
    n, e = _ne(spark, d)
    p = g.shortest_paths(e, n.where("is_entry_point = 1 and is_external = 0"), _seeds(spark, d))
    return p.select("source", "target", F.array_join("path", " > ").alias("path"), F.col("length").cast("int").alias("length"))


_DEPTHS = """WITH RECURSIVE p AS (SELECT DISTINCT caller_id AS a, callee_id AS b FROM edges WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL), n AS (SELECT a AS id FROM p UNION SELECT b FROM p),
r AS (SELECT id, 0 AS depth FROM n WHERE id NOT IN (SELECT b FROM p) UNION SELECT p.b, r.depth + 1 FROM r JOIN p ON p.a = r.id WHERE r.depth < 40)
SELECT n.id, CAST(coalesce(min(depth), -1) AS INTEGER) AS depth FROM n LEFT JOIN r ON r.id = n.id GROUP BY n.id"""


@query(_DEPTHS)
def graph_depths(spark, d):
    return g.depths_from_roots(table(spark, d, "edges"))


_REACH = """WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS a, child_id AS b FROM inheritance_edges WHERE parent_id IS NOT NULL AND child_id IS NOT NULL),
n AS (SELECT a AS id FROM e UNION SELECT b FROM e), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)"""


@query(_REACH + """, m AS (SELECT r.a AS id, r.b AS other FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a UNION SELECT id, id FROM n)
SELECT id, min(other) AS component, count(*) AS size, id IN (SELECT a FROM e WHERE a = b) AS self_loop FROM m GROUP BY id""")
def inheritance_components(spark, d):
    return g.strong_components(table(spark, d, "inheritance_edges"), "parent_id", "child_id")


@query(_REACH + """, w AS (SELECT [a, b] AS up, b AS id, 1 AS depth FROM e WHERE a NOT IN (SELECT b FROM e) UNION ALL SELECT list_append(up, e.b), e.b, depth + 1 FROM w JOIN e ON e.a = w.id WHERE NOT list_contains(up, e.b))
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id""")
def inheritance_depths(spark, d):
    rows, _ = resolve_hierarchy(table(spark, d, "inheritance_edges"))
    return rows.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"))


@query(_REACH + """, x AS (SELECT e.a, e.b FROM e JOIN reach r ON r.a = e.b AND r.b = e.a),
w AS (SELECT a AS seed, [a] AS path, b AS pos FROM x UNION ALL SELECT seed, list_append(path, pos), x.b FROM w JOIN x ON x.a = w.pos WHERE w.pos <> seed AND NOT list_contains(path, w.pos)),
m AS (SELECT seed, min((len(path), path)) AS k FROM w WHERE pos = seed GROUP BY seed), c AS (SELECT k[2] AS c, list_position(k[2], list_min(k[2])) AS i FROM m)
SELECT DISTINCT array_to_string(list_concat(c[i:], c[:i - 1]), ' > ') AS cycle, CAST(len(c) AS INTEGER) AS length FROM c""")
def inheritance_cycles(spark, d):
    return g.cycles(table(spark, d, "inheritance_edges")).select(F.array_join("cycle", " > ").alias("cycle"), "length")


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM n) AS r FROM n)"]
    for k in range(rounds):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT n.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(f.f, 0) AS r FROM n LEFT JOIN "
            f"(SELECT e.target AS id, sum(r{k}.r / o.k) AS f FROM e JOIN r{k} ON r{k}.id = e.source JOIN o ON o.id = e.source GROUP BY 1) f ON f.id = n.id)"
        )
    return f"""{_FILES}, e AS (SELECT source, target FROM l), n AS (SELECT source AS id FROM e UNION SELECT target FROM e), o AS (SELECT source AS id, count(*) AS k FROM e GROUP BY 1),
{', '.join(steps)} SELECT id, round(r / (SELECT greatest(max(r), 0.001) FROM r{rounds}), 6) AS rank FROM r{rounds}"""


@query(_pagerank_sql(12))
def file_pagerank_12(spark, d):
    """Twelve rounds, for comparison with the same rounds written out in SQL."""
    return g.pagerank(c.file_edges(table(spark, d, "edges")), rounds=12, tolerance=None).select("id", F.round("rank", 6).alias("rank"))


@query(None)
def file_pagerank(spark, d):
    return g.pagerank(c.file_edges(table(spark, d, "edges")))


@query(None)
def file_betweenness(spark, d):
    return g.betweenness(c.file_edges(table(spark, d, "edges")))


_TESTS = "(^|/)(test|tests|__tests__|spec|specs)/|[.](test|spec)[.][^./]+$|_(test|spec)[.][^./]+$|(^|/)(test|spec)_[^/]*[.][^./]+$"


def _communities_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT DISTINCT a AS id, a AS c FROM u)"]
    for k in range(rounds):
        steps.append(
            f"v{k} AS (SELECT u.a AS id, r{k}.c AS c, count(*) AS n FROM u JOIN r{k} ON r{k}.id = u.b GROUP BY 1, 2), "
            f"r{k + 1} AS MATERIALIZED (SELECT v.id, arg_min(v.c, (-n, CASE WHEN v.c <> r.c THEN 1 ELSE 0 END, v.c)) AS c FROM v{k} v JOIN r{k} r ON r.id = v.id GROUP BY v.id)"
        )
    return f"""WITH k AS (SELECT DISTINCT id FROM nodes WHERE is_external = 0 AND NOT coalesce(regexp_matches(file_path, '{_TESTS}'), false)),
p AS (SELECT DISTINCT caller_id AS a, callee_id AS b FROM edges WHERE (kind IS NULL OR kind = 'calls') AND caller_id <> callee_id AND caller_id IN (SELECT id FROM k) AND callee_id IN (SELECT id FROM k)),
u AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p), {', '.join(steps)}, co AS (SELECT k.id, coalesce(r{rounds}.c, k.id) AS community FROM k LEFT JOIN r{rounds} ON r{rounds}.id = k.id)"""


def _communities(spark, d):
    n, e = _ne(spark, d)
    return g.communities(e.where("kind is null or kind = 'calls'"), n.where("is_external = 0").where(~F.coalesce(F.col("file_path").rlike(TEST_PATH), F.lit(False))))


@query(_communities_sql(15) + " SELECT id, community FROM co")
def graph_communities(spark, d):
    """Communities of the internal functions outside test files, by label propagation in fifteen rounds."""
    return _communities(spark, d)


@query("""WITH m AS (SELECT DISTINCT file_path || '::' || class_name AS class_id, id FROM nodes WHERE class_name IS NOT NULL), n AS (SELECT class_id, count(*) AS k FROM m GROUP BY 1),
l AS (SELECT DISTINCT i.parent_id, i.child_id FROM inheritance_edges i JOIN n a ON a.class_id = i.parent_id JOIN n b ON b.class_id = i.child_id WHERE a.k * b.k <= 200)
SELECT DISTINCT a.id AS src, b.id AS dst, 'inheritance' AS via FROM l JOIN m a ON a.class_id = l.parent_id JOIN m b ON b.class_id = l.child_id
UNION SELECT DISTINCT caller_id, callee_id, 'call' FROM edges WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL""")
def graph_adjacency(spark, d):
    n, e = _ne(spark, d)
    methods = n.where("class_name is not null").select(F.concat("file_path", F.lit("::"), "class_name").alias("class_id"), "id").distinct()
    return g.adjacency_with_overrides(e, table(spark, d, "inheritance_edges"), methods)
