"""Queries that extract rows from source files and documents, and over changes and coverage, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.functions.text import split_words
from strandwork.operators import callgraph, codegraph, coverage, extract
from strandwork.plans.graph_queries import _FILES as _FILE_LINKS
from strandwork.plans.text_queries import _FILES, _LANG, _WORDS, files
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


def _rules_sql(rules, value: str) -> str:
    parts = []
    for langs, kind, pattern in rules:
        where = "" if langs is None else f" AND lang IN ({', '.join(repr(x) for x in langs)})"
        quoted = pattern.replace("'", "''")
        parts.append(f"SELECT file_id, '{kind}' AS kind, unnest(regexp_extract_all(content, '{quoted}', 1)) AS {value} FROM g WHERE content IS NOT NULL{where}")
    return f"WITH {_FILES}, g AS (SELECT *, {_LANG} AS lang FROM f), r AS ({' UNION ALL '.join(parts)})"


@query(_rules_sql(extract.IMPORTS, "source") + " SELECT * FROM r")
def extract_imports(spark, d):
    return extract.imports(files(spark, d))


@query(_rules_sql(extract.EXPORTS, "name") + " SELECT * FROM r")
def extract_exports(spark, d):
    return extract.exports(files(spark, d))


@query(_rules_sql(extract.DECLARATIONS, "signature") + " SELECT file_id, kind, trim(regexp_replace(signature, '[\\t\\n\\f\\r\\x{B} ]+', ' ', 'g')) AS signature FROM r")
def extract_declarations(spark, d):
    return extract.declarations(files(spark, d))


def _simple(name: str, rules: list) -> None:
    @query(_rules_sql(rules, "name") + " SELECT * FROM r")
    def run(spark, d):
        return extract.rule_matches(files(spark, d), rules)

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


for _name, _rules in (
    ("extract_routes", extract.ROUTES), ("extract_http_calls", extract.HTTP_CALLS), ("extract_schemas", extract.SCHEMAS), ("extract_middleware", extract.MIDDLEWARE),
    ("extract_test_titles", extract.TESTS), ("extract_parents", extract.PARENTS),
):
    _simple(_name, _rules)


@query(_rules_sql(extract.COMPONENTS, "code") + """ SELECT file_id, kind, regexp_extract(code, '^[a-z]+[ \\t\\r\\n]+([A-Za-z0-9_]+)', 1) AS name FROM r WHERE regexp_matches(code, 'return[ \\t\\r\\n]*[(]?[ \\t\\r\\n]*<') OR starts_with(code, 'class')""")
def extract_components(spark, d):
    return extract.components(files(spark, d))


@query(_rules_sql(extract.ENVIRONMENT, "name") + " SELECT name, count(DISTINCT file_id) AS n_files FROM r GROUP BY name")
def extract_environment(spark, d):
    return extract.environment(files(spark, d))


@query(
    _rules_sql(extract.IMPORTS, "source") + """, i AS (SELECT DISTINCT r.file_id, source, regexp_replace(f.file_path, '/[^/]*$', '') || '/' || source AS p FROM r JOIN f ON f.file_id = r.file_id WHERE kind IN ('import', 'require', 're_export') AND source LIKE '.%'),
i2 AS (SELECT file_id, source, array_to_string(list_reduce(list_transform(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x]), lambda a, b: CASE WHEN b = ['..'] THEN a[1:len(a) - 1] ELSE list_concat(a, b) END), '/') AS p FROM i),
o AS (SELECT file_id, source, unnest(range(0, 10)) AS pos, p FROM i2),
c AS (SELECT file_id, source, pos, CASE pos WHEN 0 THEN p ELSE regexp_replace(p, '\\.(js|jsx|mjs|cjs|ts|tsx|mts)$', '') || ['.ts', '.tsx', '.mts', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.js'][pos] END AS option FROM o)
SELECT c.file_id, source, arg_min(f.file_id, (pos, f.file_id)) AS target_id FROM c JOIN f ON f.file_path = c.option GROUP BY 1, 2"""
)
def resolved_imports(spark, d):
    return extract.resolved_imports(files(spark, d))


_PLAINDOC = "regexp_replace(text, '(?s)```.*?(?:```|$)', '', 'g')"
_HEADS = f"""h0 AS (SELECT doc_id, regexp_extract_all({_PLAINDOC}, '(?m)^(#{{1,6}}[ \\t]+[^\\r\\n]+)', 1) AS hs FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, length(regexp_extract(hs[i], '^#+')) AS level, trim(regexp_replace(hs[i], '^#+[ \\t]+', '')) AS title FROM (SELECT doc_id, hs, unnest(range(1, len(hs) + 1)) AS i FROM h0) t)"""


@query(f"WITH {_HEADS} SELECT doc_id, pos, CAST(level AS INTEGER) AS level, title FROM h")
def document_headings(spark, d):
    return extract.headings(table(spark, d, "documents"))


@query(f"WITH {_HEADS} SELECT doc_id, pos, lower(regexp_extract(title, '^(\\w+):', 1)) AS kind, regexp_extract(title, '^\\w+:[ \\t]*(.*)$', 1) AS name FROM h WHERE regexp_matches(title, '^(Requirement|Scenario):')")
def document_requirements(spark, d):
    return extract.requirements(table(spark, d, "documents"))


@query(f"""WITH {_HEADS}, m AS (SELECT doc_id, arg_min(title, pos) AS t FROM h WHERE level = 1 AND regexp_matches(title, '^ADR-[0-9]+:') GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM h WHERE level = 2 GROUP BY 1)
SELECT m.doc_id, CAST(regexp_extract(t, '^ADR-0*([0-9]+):', 1) AS BIGINT) AS number, regexp_extract(t, '^ADR-[0-9]+:[ \\t]*(.*)$', 1) AS title, coalesce(n, 0) AS n_sections FROM m LEFT JOIN n ON n.doc_id = m.doc_id""")
def decision_records(spark, d):
    return extract.decision_records(table(spark, d, "documents"))


@query(f"""WITH {_HEADS}, q AS (SELECT count(*) AS n_requirements, count(DISTINCT doc_id) AS n_docs FROM h WHERE starts_with(title, 'Requirement:')) SELECT * FROM q""")
def requirement_count(spark, d):
    r = extract.requirements(table(spark, d, "documents")).where("kind = 'requirement'")
    return r.agg(F.count(F.lit(1)).alias("n_requirements"), F.count_distinct("doc_id").alias("n_docs"))


@query(None)
def document_chunks(spark, d):
    return extract.chunks(table(spark, d, "documents").select("doc_id", "text"))


@query(f"""WITH {_FILES} SELECT regexp_replace(file_path, '/[^/]*$', '') AS directory, count(*) AS n_files, count(DISTINCT {_LANG}) AS n_languages, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS n_chars FROM f GROUP BY 1""")
def directory_stats(spark, d):
    return coverage.directory_stats(files(spark, d))


@query(f"""WITH {_FILES}, l AS (SELECT {_LANG} AS language, count(*) AS n FROM f GROUP BY 1) SELECT language, n, CAST(floor(100.0 * n / (SELECT sum(n) FROM l) + 0.5) AS BIGINT) AS percent FROM l""")
def language_breakdown(spark, d):
    from strandwork.functions.text import language_of

    c = files(spark, d).groupBy(language_of("file_path").alias("language")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).first()[0] or 1
    return c.select("language", "n", F.floor(100.0 * F.col("n") / F.lit(total) + 0.5).cast("long").alias("percent"))


def _points(names: dict[str, int], n: str) -> list[str]:
    return [f"CASE WHEN contains({n}, '{k}') THEN {v} ELSE 0 END" for k, v in names.items()]


_BASE = "lower(list_extract(string_split(file_path, '/'), -1))"
_STRUCT = """least(25, greatest(0, coalesce(CASE WHEN regexp_matches(content, '\\bclass\\s+\\w+') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(content, '\\b(?:interface|type)\\s+\\w+\\s*[={<]') THEN 15 ELSE 0 END
+ CASE WHEN regexp_matches(content, '\\bexport\\s+(?:default\\s+)?(?:class|function|const|let|var|interface|type|enum)') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(content, '@\\w+\\s*\\(') THEN 15 ELSE 0 END
+ CASE WHEN len(regexp_extract_all(content, '\\bimport\\s+.*from\\s+[''"][^''"]+[''"]')) > 10 THEN 10 ELSE 0 END + CASE WHEN len(string_split(content, chr(10))) BETWEEN 50 AND 500 THEN 5 WHEN len(string_split(content, chr(10))) > 1000 THEN -5 ELSE 0 END, 0)))"""


_PLACE = "greatest(CASE WHEN depth = 0 THEN 15 ELSE 0 END, CASE WHEN regexp_matches(file_path, '(^|/)(core|domain|models|api|routes|controllers|schemas)/') THEN 15 ELSE 0 END, CASE WHEN regexp_matches(file_path, '(^|/)(src|lib|config|configs|services)/') THEN 10 ELSE 0 END) - CASE WHEN depth > 5 THEN 10 ELSE 0 END - CASE WHEN depth > 3 AND (contains(lower(file_path), 'utils/') OR contains(lower(file_path), 'helpers/')) THEN 5 ELSE 0 END"


@query(_FILE_LINKS + f""", {_FILES}, dg AS (SELECT file, sum(i) AS i, sum(o) AS o FROM (SELECT target AS file, 1 AS i, 0 AS o FROM l UNION ALL SELECT source, 0, 1 FROM l) t GROUP BY file),
fd AS (SELECT f.*, len(string_split(file_path, '/')) - 1 AS depth, coalesce(i, 0) AS i, coalesce(o, 0) AS o, {_BASE} AS nm FROM f LEFT JOIN dg ON dg.file = f.file_path),
s AS (SELECT file_id, file_path, nm, depth, least(30, greatest(0, greatest(0, {', '.join(_points(coverage.NAME_POINTS, 'nm'))}) + {' + '.join(_points(coverage.NAME_LOSSES, 'nm'))})) AS name_score, least(25, greatest(0, {_PLACE})) AS path_score, {_STRUCT} AS structure_score,
least(20, greatest(0, CASE WHEN i >= 5 THEN 20 WHEN i >= 2 THEN 10 ELSE 0 END + CASE WHEN o >= 5 THEN 10 ELSE 0 END + CASE WHEN i = 0 AND o = 0 THEN -10 ELSE 0 END)) AS connectivity_score FROM fd)
SELECT file_id, name_score, path_score, structure_score, connectivity_score, least(100, greatest(0, name_score + path_score + structure_score + connectivity_score)) AS score,
array_to_string(list_filter([CASE WHEN regexp_matches(nm, 'schema|model|entity') THEN 'schema' END, CASE WHEN regexp_matches(nm, 'api|route|controller') THEN 'api' END, CASE WHEN regexp_matches(nm, 'service|provider') THEN 'service' END,
CASE WHEN name_score >= 20 THEN 'high-value-name' END, CASE WHEN connectivity_score >= 15 THEN 'high-connectivity' END], lambda x: x IS NOT NULL), ' ') AS tags FROM s""")
def file_significance(spark, d):
    """Scores and tags of all files; the flags of the path, which path_metadata gives, are left out of the tags here."""
    degrees = callgraph.file_degrees(callgraph.file_edges(table(spark, d, "edges")))
    flags = F.array(*map(F.lit, ("entry-point", "config", "test", "generated")))
    return coverage.significance(files(spark, d), degrees).withColumn("tags", F.array_join(F.array_except("tags", flags), " "))


@query("""WITH h AS (SELECT DISTINCT edge_id, callee_file AS file_path, line AS a, line + 120 AS b FROM edges WHERE line IS NOT NULL AND callee_file IS NOT NULL), s AS (SELECT DISTINCT id, file_path, start_index AS s, end_index AS e FROM nodes WHERE start_index IS NOT NULL AND end_index IS NOT NULL)
SELECT h.edge_id, s.id, CAST(least(b, e) - greatest(a, s) + 1 AS BIGINT) AS overlap FROM h JOIN s ON s.file_path = h.file_path AND a <= e AND b >= s""")
def change_overlaps(spark, d):
    h = table(spark, d, "edges").where("line is not null").select("edge_id", F.col("callee_file").alias("file_path"), F.col("line").alias("a"), (F.col("line") + 120).alias("b")).distinct()
    s = table(spark, d, "nodes").select("id", "file_path", F.col("start_index").alias("s"), F.col("end_index").alias("e")).distinct()
    return coverage.overlaps(h, s, "file_path", "a", "b", "s", "e").select("edge_id", "id", F.col("overlap").cast("long").alias("overlap"))


@query("""WITH h AS (SELECT DISTINCT edge_id, callee_file AS file_path, line * 3 AS a FROM edges WHERE line IS NOT NULL AND callee_file IS NOT NULL), s AS (SELECT DISTINCT id, file_path, start_index AS s, end_index AS e FROM nodes WHERE start_index IS NOT NULL)
SELECT h.edge_id, arg_min(s.id, (e - s, s.id)) AS id FROM h JOIN s ON s.file_path = h.file_path AND s <= a AND a < e GROUP BY 1""")
def enclosing_functions(spark, d):
    h = table(spark, d, "edges").where("line is not null").select("edge_id", F.col("callee_file").alias("file_path"), (F.col("line") * 3).alias("a")).distinct()
    s = table(spark, d, "nodes").select("id", "file_path", F.col("start_index").alias("s"), F.col("end_index").alias("e")).distinct()
    return coverage.enclosing(h, s, "file_path", "a", "s", "e", "id", "edge_id")


_CUT = "2024-12-15"
_CHANGES = f"""c AS (SELECT file_path AS path, CASE WHEN removed_at IS NOT NULL THEN 'deleted' WHEN epoch_ms(first_seen_at) >= epoch_ms(TIMESTAMP '{_CUT}') THEN 'added' ELSE 'modified' END AS status, length(file_path) AS n FROM file_hashes WHERE removed_at IS NOT NULL OR epoch_ms(first_seen_at) >= epoch_ms(TIMESTAMP '{_CUT}') OR updated_at >= epoch_ms(TIMESTAMP '{_CUT}')),
m AS (SELECT DISTINCT list_extract(string_split(file_path, '/'), 4) AS domain, file_path AS path FROM nodes WHERE file_path IS NOT NULL AND is_external = 0)"""
_SEV = """CASE kind WHEN 'gap' THEN CASE WHEN n > 30 AND high THEN 'error' WHEN n > 5 THEN 'warning' ELSE 'info' END WHEN 'stale' THEN CASE WHEN status = 'deleted' THEN 'error' ELSE 'warning' END WHEN 'uncovered' THEN CASE WHEN high THEN 'warning' ELSE 'info' END ELSE 'warning' END"""


@query(f"""WITH {_CHANGES}, u AS (
SELECT 'gap' AS kind, domain, c.path, status, n FROM c JOIN m ON m.path = c.path WHERE status IN ('modified', 'added') AND domain NOT IN ('core', 'util')
UNION SELECT 'stale', domain, c.path, status, n FROM c JOIN m ON m.path = c.path WHERE status = 'deleted'
UNION SELECT 'uncovered', NULL, path, status, n FROM c WHERE status = 'added' AND path NOT IN (SELECT path FROM m)
UNION SELECT 'orphaned', domain, path, NULL, 0 FROM m WHERE path NOT IN (SELECT file_path FROM file_hashes)),
k AS (SELECT *, regexp_matches(list_extract(string_split(path, '/'), -1), '(?i)(service|controller|handler|middleware|model|schema|entity|repository|route|api|auth|database)') AS high FROM u) SELECT DISTINCT kind, domain, path, {_SEV} AS severity FROM k""")
def specification_drift(spark, d):
    h = table(spark, d, "file_hashes")
    since = F.lit(_CUT).cast("timestamp")
    added = F.col("first_seen_at") >= since
    c = h.where(F.col("removed_at").isNotNull() | added | (F.col("updated_at") >= F.unix_millis(since))).select(
        F.col("file_path").alias("path"), F.when(F.col("removed_at").isNotNull(), "deleted").when(added, "added").otherwise("modified").alias("status"), F.lit(None).cast("string").alias("old_path"), F.length("file_path").alias("n_changes")
    )
    m = table(spark, d, "nodes").where("is_external = 0 and file_path is not null").select(F.try_element_at(F.split("file_path", "/"), F.lit(4)).alias("domain"), F.col("file_path").alias("path"))
    return coverage.drift(c, m, h.select(F.col("file_path").alias("path")), spark.createDataFrame([("core",), ("util",)], "domain string"))


_F = "file_hashes"


@query(f"""WITH n AS (SELECT file_id, file_path, scanned_at, row_number() OVER (PARTITION BY file_path ORDER BY scanned_at DESC) AS i FROM (SELECT DISTINCT file_id, file_path, scanned_at FROM source_files) t)
SELECT file_path, CAST(epoch_ms(scanned_at) AS BIGINT) AS updated_at FROM n WHERE i = 1 UNION ALL SELECT file_path, updated_at FROM {_F} WHERE file_path NOT IN (SELECT file_path FROM n)""")
def store_upsert_hashes(spark, d):
    old = table(spark, d, "file_hashes").select("file_path", "updated_at")
    new = table(spark, d, "source_files").select("file_path", F.unix_millis("scanned_at").alias("updated_at"))
    return coverage.upsert(old, new, ["file_path"], "updated_at")


@query("""SELECT edge_id, caller_id, callee_id FROM (SELECT DISTINCT edge_id, caller_id, callee_id, caller_file, callee_file FROM edges) e
WHERE coalesce(caller_file, '') NOT IN (SELECT file_path FROM file_hashes WHERE removed_at IS NOT NULL) AND coalesce(callee_file, '') NOT IN (SELECT file_path FROM file_hashes WHERE removed_at IS NOT NULL)""")
def store_delete_edges_of_removed_files(spark, d):
    e = table(spark, d, "edges").select("edge_id", "caller_id", "callee_id", "caller_file", "callee_file").distinct()
    gone = table(spark, d, "file_hashes").where("removed_at is not null").select("file_path")
    e = e.join(gone.withColumnRenamed("file_path", "caller_file"), "caller_file", "left_anti").join(gone.withColumnRenamed("file_path", "callee_file"), "callee_file", "left_anti")
    return e.select("edge_id", "caller_id", "callee_id")


@query(f"""WITH {_HEADS}, r AS (SELECT DISTINCT name AS req, list_distinct(string_split(lower(name), ' ')) AS w FROM (SELECT regexp_extract(title, '^Requirement:[ \\t]*(.*)$', 1) AS name FROM h WHERE starts_with(title, 'Requirement:')) t),
f AS (SELECT DISTINCT id, list_distinct({_WORDS}) AS w FROM nodes WHERE is_external = 0), a AS (SELECT req, len(w) AS nr, unnest(w) AS w FROM r), b AS (SELECT id, len(w) AS nf, unnest(w) AS w FROM f),
j AS (SELECT req, id, nr, nf, count(*) AS k FROM a JOIN b ON a.w = b.w GROUP BY 1, 2, 3, 4), s AS (SELECT req, id, round(CAST(k AS DOUBLE) / (nr + nf - k), 6) AS similarity FROM j),
t AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY similarity DESC, id) AS i FROM s WHERE similarity >= 0.6) SELECT req, id, similarity FROM t WHERE i <= 2""")
def requirement_links(spark, d):
    r = extract.requirements(table(spark, d, "documents")).where("kind = 'requirement'").select(F.col("name").alias("req"), F.split(F.lower("name"), " ").alias("words")).distinct()
    f = table(spark, d, "nodes").where("is_external = 0").select("id", split_words("name").alias("words")).distinct()
    return coverage.requirement_links(r, f, 0.6)


@query(None)
def change_risk(spark, d):
    """Risk of every internal function, were half of it changed: callers further up, tests and external calls counted."""
    n, e = table(spark, d, "nodes"), cut(callgraph.one_edge_each(table(spark, d, "edges")))
    f = callgraph.with_degrees(n, e).where("is_external = 0 and start_index is not null and end_index is not null").select(
        "id", F.greatest(F.lit(1), F.col("end_index") - F.col("start_index")).alias("length"), "fan_in"
    ).distinct()
    f = cut(f.withColumn("changed", F.floor(F.col("length") * 0.5 + 0.5)).withColumn("kind", F.lit("logic")))
    zero = {"test_weight": 0.0, "transitive": 0.0, "boundary": 0.0}
    full = f.join(coverage.transitive_scores(e, f.select("id")), "id", "left").join(coverage.boundary_scores(e, n), "id", "left").join(coverage.test_weights(callgraph.tested_by(e, n)), "id", "left").fillna(zero)
    return coverage.change_risk(full).select("id", "transitive", "boundary", "test_weight", "risk")


@query(f"""WITH {_FILES}, n AS (SELECT DISTINCT id, file_path, is_hub, fan_in FROM nodes WHERE is_external = 0), g AS (SELECT file_path, bool_or(is_hub = 1) AS hub, coalesce(max(fan_in), 0) AS mx, count(*) AS n_functions FROM n GROUP BY 1)
SELECT file_path, n_functions, 1 + CASE WHEN hub THEN 2 ELSE 0 END + least(3, CAST(ceil(mx / 5.0) AS INTEGER)) AS weight FROM g""")
def change_weights(spark, d):
    g = table(spark, d, "nodes").where("is_external = 0").select("id", "file_path", "is_hub", "fan_in").distinct().groupBy("file_path").agg(
        F.bool_or(F.col("is_hub") == 1).alias("hub"), F.coalesce(F.max("fan_in"), F.lit(0)).alias("mx"), F.count(F.lit(1)).alias("n_functions")
    )
    return g.select("file_path", "n_functions", (1 + F.when(F.col("hub"), 2).otherwise(0) + F.least(F.lit(3), F.ceil(F.col("mx") / 5.0).cast("int"))).alias("weight"))


@query(None)
def built_functions(spark, d):
    """Functions that the call-graph builder finds in the source files."""
    return codegraph.build_call_graph(files(spark, d))[0]


@query(None)
def built_call_edges(spark, d):
    """Calls between them, resolved with the relative imports of the files."""
    f = files(spark, d)
    i = extract.resolved_imports(f).join(f.select("file_id", "file_path"), "file_id").join(f.select(F.col("file_id").alias("target_id"), F.col("file_path").alias("target_path")), "target_id")
    return codegraph.build_call_graph(f, i.select("file_path", "target_path"))[1]
