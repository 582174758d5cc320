"""Queries over specifications and communities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.operators import callgraph, specs
from strandwork.plans.graph_queries import _communities, _communities_sql
from strandwork.plans.text_queries import _FILES, _TOK, files
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


_RULES = " UNION ALL ".join(
    f"SELECT doc_id, '{rule}' AS rule, '{level}' AS level FROM documents WHERE doc_kind = 'spec' AND text IS NOT NULL AND regexp_matches(text, '{p}') <> {'true' if need else 'false'}" for rule, level, p, need in specs.RULES
)


@query(_RULES)
def spec_validation(spark, d):
    return specs.validate(table(spark, d, "documents").where("doc_kind = 'spec'"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in specs.CLAUSES) + " ELSE 'other' END"


@query(f"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '(Given [^.\\r\\n]*?, when [^.\\r\\n]*?, then [^.\\r\\n]*)', 1) AS s FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS x FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s) t), v AS (SELECT doc_id, pos, trim(regexp_extract(x, '^Given (.*?), when ', 1)) AS given, trim(regexp_extract(x, ', when (.*?), then ', 1)) AS when_clause, trim(regexp_extract(x, ', then (.*)$', 1)) AS t FROM u)
SELECT doc_id, pos, given, when_clause, t AS then_clause, {_KIND} AS kind FROM v""")
def spec_scenarios(spark, d):
    return specs.scenarios(table(spark, d, "documents"))


@query("""WITH s AS (SELECT source, count(*) AS n_specs, CAST(sum(CASE WHEN regexp_matches(text, '(?m)^####[ \\t]+Scenario:') THEN 1 ELSE 0 END) AS BIGINT) AS n_covered FROM documents WHERE doc_kind = 'spec' AND text IS NOT NULL GROUP BY source)
SELECT *, floor(100.0 * n_covered / n_specs * 10 + 0.5) / 10 AS percent FROM s""")
def spec_scenario_coverage(spark, d):
    s = table(spark, d, "documents").where("doc_kind = 'spec' and text is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n_specs"), F.sum(F.col("text").rlike(r"(?m)^####[ \t]+Scenario:").cast("int")).alias("n_covered"))
    return s.withColumn("percent", specs.coverage_percent(F.col("n_covered"), F.col("n_specs"), 1))


@query("""WITH n AS (SELECT DISTINCT id, file_path, is_hub, is_entry_point FROM nodes WHERE is_external = 0), c AS (SELECT list_extract(string_split(file_path, '/'), 4) AS cluster, count(DISTINCT file_path) AS n_files, count(*) AS n_functions,
CAST(sum(CASE WHEN is_entry_point = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_entry, CAST(sum(CASE WHEN is_hub = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_hub FROM n GROUP BY 1)
SELECT *, CASE WHEN n_entry * 2 > n_files THEN 'entry_layer' WHEN n_entry > 0 AND n_hub > 0 THEN 'orchestrator' WHEN n_hub > 0 THEN 'core_utilities' WHEN n_entry > 0 THEN 'api_layer' ELSE 'internal' END AS role FROM c""")
def architecture_clusters(spark, d):
    return specs.clusters(table(spark, d, "nodes"))


@query(_communities_sql(15) + """, q AS (SELECT DISTINCT caller_id, callee_id FROM edges WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL), fi AS (SELECT callee_id AS id, count(*) AS n FROM q GROUP BY 1),
inn AS (SELECT x.community, count(*) AS k FROM q JOIN co x ON x.id = q.caller_id JOIN co y ON y.id = q.callee_id AND y.community = x.community GROUP BY 1),
g AS (SELECT community, count(*) AS size, arg_min(co.id, (-coalesce(fi.n, 0), co.id)) AS label FROM co LEFT JOIN fi ON fi.id = co.id GROUP BY 1)
SELECT g.community, label, size, coalesce(k, 0) AS internal_edges, CASE WHEN size < 2 THEN 0.0 ELSE CAST(coalesce(k, 0) AS DOUBLE) / (size * (size - 1)) END AS density FROM g LEFT JOIN inn ON inn.community = g.community""")
def community_report(spark, d):
    n, e = table(spark, d, "nodes"), table(spark, d, "edges")
    return specs.community_report(_communities(spark, d), callgraph.call_pairs(e), callgraph.degrees(n, e))


_ST = f"list_distinct(list_transform(list_filter({_TOK}, lambda x: length(x) > 3), lambda x: x[1:5]))"


@query(f"""WITH c AS (SELECT DISTINCT candidate_id, docstring, reason, name FROM insertion_candidates WHERE docstring IS NOT NULL AND name IS NOT NULL), s AS (SELECT candidate_id, {_ST.format('docstring')} AS a, {_ST.format('reason')} AS b FROM c WHERE reason IS NOT NULL)
SELECT candidate_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM s""")
def purpose_similarity(spark, d):
    c = table(spark, d, "insertion_candidates").where("docstring is not null and name is not null and reason is not null").select("candidate_id", "docstring", "reason", "name").distinct()
    return c.select("candidate_id", F.round(specs.purpose_similarity(F.col("docstring"), F.col("reason")), 6).alias("similarity"))


@query(f"""WITH {_FILES}, x AS (SELECT file_id, list_concat(list_concat(regexp_extract_all(content, '\\b(?:const|let|var)\\s+\\w+(?:\\s*:\\s*[A-Z]\\w*|\\s*=\\s*new\\s+[A-Z]\\w*)'), regexp_extract_all(content, '\\b\\w+(?:\\s*:\\s*[A-Z]\\w*\\s*=|\\s*=\\s*[A-Z]\\w*\\()')), regexp_extract_all(content, '\\b\\w+\\s*:=\\s*&?[A-Z]\\w*\\{{|\\bvar\\s+\\w+\\s+\\*?[A-Z]\\w*')) AS ds FROM f WHERE content IS NOT NULL),
u AS (SELECT file_id, i, ds[i] AS d FROM (SELECT file_id, ds, unnest(range(1, len(ds) + 1)) AS i FROM x) t), v AS (SELECT file_id, i, regexp_extract(d, '^(?:(?:const|let|var)\\s+)?(\\w+)', 1) AS variable, regexp_extract(d, '^(?:(?:const|let|var)\\s+)?\\w+[^A-Z]*([A-Z]\\w*)', 1) AS type FROM u)
SELECT file_id, variable, arg_max(type, i) AS type FROM v WHERE type <> '' GROUP BY 1, 2""")
def inferred_types(spark, d):
    return specs.infer_types(files(spark, d))
