"""Queries that put several operators together, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.operators import callgraph, graph, retrieval, routes
from strandwork.plans.graph_queries import _DEG, _FILES
from strandwork.plans.text_queries import _BM25, _FUN, _TASKS_SQL, _TOK, _WORDS, _functions, _tasks
from strandwork.functions.text import split_words
from strandwork.sources import files as sources
from strandwork.sources.tables import table
from strandwork.util import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# the specification search under names of its own, for use beside the function search
_SPEC = _BM25
for _a, _b in (("k AS", "k2 AS"), ("FROM docs)", "FROM docs2)"), ("FROM k)", "FROM k2)"), ("st AS", "st2 AS"), ("po AS", "po2 AS"), ("FROM po ", "FROM po2 "), ("\npo", "\npo"), (" p AS", " p2 AS"), ("df AS (SELECT term, count(*) AS df FROM p ", "df2 AS (SELECT term, count(*) AS df FROM p2 "), ("qt AS", "qt2 AS"), ("FROM qt ", "FROM qt2 "), (" q AS", " q2 AS"), ("sc AS", "sc2 AS"), ("FROM q JOIN p ON", "FROM q2 q JOIN p2 p ON"), ("JOIN df ON", "JOIN df2 df ON"), ("CROSS JOIN st ", "CROSS JOIN st2 st "), ("bm AS", "bm2 AS"), ("FROM sc WHERE", "FROM sc2 WHERE")):
    _SPEC = _SPEC.replace(_a, _b)
_DOCS2 = "docs2 AS (SELECT doc_id AS id, text FROM documents WHERE doc_kind = 'spec')"
_BOTH = f"WITH {_TASKS_SQL}, {_FUN}, {_BM25}, {_DOCS2}, {_SPEC}"


def _specs(spark, d, k=10):
    s = table(spark, d, "documents").where("doc_kind = 'spec'").select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25(s, "id", "text", _tasks(spark, d), k=k)


@query(_BOTH + """, hit AS (SELECT query_id, id, rank, score FROM bm WHERE rank <= 10), n AS (SELECT id, min(file_path) AS file_path, min(signature) AS signature, min(fan_in) AS fi, min(fan_out) AS fo, max(is_hub) AS hub, max(is_entry_point) AS ent FROM nodes GROUP BY id),
do1 AS (SELECT query_id, list_extract(string_split(file_path, '/'), 4) AS id, min(rank) AS best FROM hit JOIN n ON n.id = hit.id GROUP BY 1, 2),
in1 AS (SELECT query_id, hit.id, score / max(score) OVER (PARTITION BY query_id) AS share, CASE WHEN ent = 1 THEN 'entry_point' WHEN hub = 1 THEN 'hub' WHEN fo >= 5 THEN 'orchestrator' WHEN fi <= 1 THEN 'utility' ELSE 'internal' END AS role FROM hit LEFT JOIN n ON n.id = hit.id),
in2 AS (SELECT *, round(0.6 * share + 0.4 * CASE role WHEN 'entry_point' THEN 1.0 WHEN 'orchestrator' THEN 0.8 WHEN 'hub' THEN 0.6 WHEN 'internal' THEN 0.4 ELSE 0.3 END, 6) AS fit FROM in1), in3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fit DESC, id) AS rank FROM in2),
fl AS (SELECT query_id, file_path AS id, min(rank) AS best FROM hit JOIN n ON n.id = hit.id GROUP BY 1, 2),
e1 AS (SELECT DISTINCT callee_id AS hit, caller_id AS id FROM edges WHERE callee_id IN (SELECT id FROM hit) AND caller_id IS NOT NULL), e2 AS (SELECT DISTINCT caller_id AS hit, callee_id AS id FROM edges WHERE caller_id IN (SELECT id FROM hit) AND callee_id IS NOT NULL),
r1 AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY id) AS rank FROM e1), r2 AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY id) AS rank FROM e2)
SELECT query_id, 'function' AS section, hit.id, signature AS detail, CAST(rank AS INTEGER) AS rank FROM hit LEFT JOIN n ON n.id = hit.id
UNION ALL SELECT query_id, 'file', id, NULL, row_number() OVER (PARTITION BY query_id ORDER BY best, id) FROM fl
UNION ALL SELECT query_id, 'domain', id, NULL, row_number() OVER (PARTITION BY query_id ORDER BY best, id) FROM do1 WHERE id IS NOT NULL
UNION ALL SELECT query_id, 'insertion', id, CASE role WHEN 'entry_point' THEN 'extend_entry_point' WHEN 'orchestrator' THEN 'add_orchestration_step' WHEN 'hub' THEN 'cross_cutting_hook' WHEN 'utility' THEN 'extract_shared_logic' ELSE 'call_alongside' END, rank FROM in3 WHERE rank <= 5
UNION ALL SELECT hit.query_id, 'caller', r1.id, r1.hit, r1.rank FROM hit JOIN r1 ON r1.hit = hit.id WHERE r1.rank <= 5
UNION ALL SELECT hit.query_id, 'callee', r2.id, r2.hit, r2.rank FROM hit JOIN r2 ON r2.hit = hit.id WHERE r2.rank <= 5
UNION ALL SELECT query_id, 'spec', CAST(id AS VARCHAR), NULL, rank FROM bm2 WHERE rank <= 5""")
def orient(spark, d):
    hits = retrieval.bm25(_functions(spark, d), "id", "text", _tasks(spark, d))
    return routes.orient(hits, table(spark, d, "edges"), table(spark, d, "nodes"), _specs(spark, d, 5))


_LINKS = f"""w1 AS (SELECT DISTINCT id, unnest({_WORDS}) AS w FROM nodes WHERE is_external = 0), w2 AS (SELECT DISTINCT doc_id, unnest({_TOK.format('title')}) AS w FROM (SELECT doc_id, regexp_extract(text, 'Requirement:[ \\t]*([^\\r\\n]*)', 1) AS title FROM documents WHERE doc_kind = 'spec' AND text IS NOT NULL) t),
lk AS (SELECT id AS f, CAST(doc_id AS VARCHAR) AS s FROM w1 JOIN w2 ON w1.w = w2.w GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query(_BOTH + f""", {_LINKS}, a AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS share FROM bm WHERE rank <= 50), b AS (SELECT query_id, CAST(id AS VARCHAR) AS id, score / max(score) OVER (PARTITION BY query_id) AS share FROM bm2 WHERE rank <= 50),
sn AS (SELECT a.query_id, lk.f, lk.s FROM a JOIN lk ON lk.f = a.id JOIN b ON b.id = lk.s AND b.query_id = a.query_id), nn AS (SELECT query_id, f AS id, 'code' AS kind, count(*) AS n FROM sn GROUP BY 1, 2 UNION ALL SELECT query_id, s, 'spec', count(*) FROM sn GROUP BY 1, 2),
u AS (SELECT *, 'code' AS kind FROM a UNION ALL SELECT *, 'spec' FROM b), sc9 AS (SELECT u.query_id, u.id, CASE WHEN n IS NOT NULL THEN 'both' ELSE u.kind END AS kind, round(share + CASE WHEN n IS NULL THEN 0.0 ELSE 0.3 + least((n - 1) * 0.1, 0.3) END, 6) AS score FROM u LEFT JOIN nn ON nn.query_id = u.query_id AND nn.id = u.id AND nn.kind = u.kind),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, id) AS INTEGER) AS rank FROM sc9) SELECT * FROM rk WHERE rank <= 10""")
def search_unified(spark, d):
    code = retrieval.bm25(_functions(spark, d), "id", "text", _tasks(spark, d), k=50)
    title = F.regexp_extract("text", r"Requirement:[ \t]*([^\r\n]*)", 1)
    from strandwork.functions.text import tokens

    w1 = table(spark, d, "nodes").where("is_external = 0").select("id", F.explode(split_words("name")).alias("w"))
    w2 = table(spark, d, "documents").where("doc_kind = 'spec' and text is not null").select(F.col("doc_id").alias("id"), F.explode(tokens(title)).alias("w"))
    specs = _specs(spark, d, 50)
    return routes.unified_search(code, specs, cut(routes.hit_links(code, specs, w1, w2)))


@query(f"WITH {_TASKS_SQL}, {_FUN}, {_BM25}, n AS (SELECT id, min(language) AS language, min(fan_in) AS fan_in FROM nodes GROUP BY id) SELECT query_id, bm.id, score, rank FROM bm JOIN n ON n.id = bm.id WHERE rank <= 30 AND language = 'Go' AND fan_in >= 3")
def search_functions_filtered(spark, d):
    """The best 30 first, then the filters on language and fan-in, as the function index does."""
    hits = retrieval.bm25(_functions(spark, d), "id", "text", _tasks(spark, d), k=30)
    n = table(spark, d, "nodes").groupBy("id").agg(F.min("language").alias("language"), F.min("fan_in").alias("fan_in"))
    return hits.join(n, "id").where("language = 'Go' and fan_in >= 3").select("query_id", "id", "score", "rank")


@query("""SELECT document, symbol, role, n FROM (SELECT DISTINCT file_path AS document, id AS symbol, 'definition' AS role, 1 AS n FROM nodes WHERE is_external = 0
UNION ALL SELECT caller_file, callee_id, 'reference', count(DISTINCT edge_id) FROM edges WHERE caller_file IS NOT NULL AND callee_id IS NOT NULL GROUP BY 1, 2) t""")
def export_symbol_index(spark, d):
    return sources.symbol_index(table(spark, d, "nodes"), table(spark, d, "edges"))


@query(_FILES + """, dg AS (SELECT file AS id, sum(i) AS score FROM (SELECT target AS file, 1 AS i FROM l UNION ALL SELECT source, 0 FROM l) t GROUP BY 1), b AS (SELECT id FROM dg ORDER BY score DESC, id LIMIT 30)
SELECT 'graph LR' || chr(10) || string_agg(DISTINCT '  "' || source || '" --> "' || target || '"', chr(10) ORDER BY '  "' || source || '" --> "' || target || '"') AS text FROM l WHERE source IN (SELECT id FROM b) AND target IN (SELECT id FROM b)""")
def export_mermaid(spark, d):
    links = callgraph.file_edges(table(spark, d, "edges"))
    return sources.mermaid(links, callgraph.file_degrees(links).select(F.col("file").alias("id"), F.col("in_degree").alias("score")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT caller_id AS a, callee_id AS b FROM edges WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL), n AS (SELECT a AS id FROM e UNION SELECT b FROM e),
live AS (SELECT a, b FROM e WHERE b IN (SELECT a FROM e) AND a IN (SELECT b FROM e)), reach AS (SELECT a, b FROM live UNION SELECT reach.a, live.b FROM reach JOIN live ON live.a = reach.b),
m AS (SELECT r.a AS id, r.b AS other FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a UNION SELECT id, id FROM n)
SELECT id, min(other) AS component, count(*) AS size, id IN (SELECT a FROM e WHERE a = b) AS self_loop FROM m GROUP BY id""")
def graph_components(spark, d):
    return graph.strong_components(table(spark, d, "edges"))


@query(_DEG + """, two AS (SELECT DISTINCT a.caller_id AS id FROM p a JOIN p b ON a.caller_id = b.callee_id AND a.callee_id = b.caller_id),
s AS (SELECT d.id, fan_in, fan_out, CASE WHEN fan_in = 0 THEN 1.0 ELSE 0.0 END + CASE WHEN fan_in >= 8 THEN 2 + least(3.0, (fan_in - 8) / 8.0) ELSE 0 END + CASE WHEN fan_out >= 8 THEN 2 + least(3.0, (fan_out - 8) / 8.0) ELSE 0 END + CASE WHEN two.id IS NOT NULL THEN 2.0 ELSE 0 END AS p,
CAST(fan_in = 0 AS INTEGER) + CAST(fan_in >= 8 AS INTEGER) + CAST(fan_out >= 8 AS INTEGER) + CAST(two.id IS NOT NULL AS INTEGER) AS n FROM d LEFT JOIN two ON two.id = d.id WHERE is_external = 0)
SELECT id, fan_in, fan_out, n AS n_issues, floor(p * 10 + 0.5) / 10 AS priority FROM s WHERE n > 0""")
def refactor_priorities(spark, d):
    """Unreachable, much called, much calling and mutually recursive functions with their priority."""
    n, e = table(spark, d, "nodes"), table(spark, d, "edges")
    p = callgraph.call_pairs(e)
    two = p.join(p.select(F.col("callee_id").alias("caller_id"), F.col("caller_id").alias("callee_id")), ["caller_id", "callee_id"], "left_semi").select(F.col("caller_id").alias("id"), F.lit(1).alias("two")).distinct()
    f = callgraph.with_degrees(n, e).where("is_external = 0").join(two, "id", "left")
    over = lambda c: F.when(F.col(c) >= 8, 2 + F.least(F.lit(3.0), (F.col(c) - 8) / 8.0)).otherwise(0.0)
    flags = [F.col("fan_in") == 0, F.col("fan_in") >= 8, F.col("fan_out") >= 8, F.col("two").isNotNull()]
    points = F.when(flags[0], 1.0).otherwise(0.0) + over("fan_in") + over("fan_out") + F.when(flags[3], 2.0).otherwise(0.0)
    return f.select("id", "fan_in", "fan_out", sum((x.cast("int") for x in flags), F.lit(0)).alias("n_issues"), (F.floor(points * 10 + 0.5) / 10).alias("priority")).where("n_issues > 0")


@query("""WITH n AS (SELECT DISTINCT id, file_path, docstring, is_hub FROM nodes WHERE is_external = 0), k AS (SELECT list_extract(string_split(file_path, '/'), 4) AS domain, count(*) AS n_functions, CAST(sum(CASE WHEN docstring IS NOT NULL AND trim(docstring) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_covered,
CAST(sum(CASE WHEN is_hub = 1 AND (docstring IS NULL OR trim(docstring) = '') THEN 1 ELSE 0 END) AS BIGINT) AS n_hub_gaps FROM n GROUP BY 1) SELECT *, CAST(floor(100.0 * n_covered / n_functions + 0.5) AS BIGINT) AS percent FROM k""")
def coverage_by_domain(spark, d):
    n = table(spark, d, "nodes").where("is_external = 0").select("id", "file_path", "docstring", "is_hub").distinct()
    has = F.coalesce(F.trim("docstring") != "", F.lit(False))
    k = n.groupBy(F.try_element_at(F.split("file_path", "/"), F.lit(4)).alias("domain")).agg(
        F.count(F.lit(1)).alias("n_functions"), F.sum(has.cast("int")).alias("n_covered"), F.sum(((F.col("is_hub") == 1) & ~has).cast("int")).alias("n_hub_gaps")
    )
    return k.withColumn("percent", F.floor(100.0 * F.col("n_covered") / F.col("n_functions") + 0.5))


