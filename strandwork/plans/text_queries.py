"""Queries over texts, names and paths, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import text as t
from strandwork.operators import clones, codegraph, retrieval
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


_FILES = "f0 AS (SELECT file_id, arg_max({'repo': repo, 'file_path': file_path, 'content': content, 'language': language}, (scanned_at, coalesce(content, ''))) AS r FROM source_files GROUP BY file_id), f AS (SELECT file_id, r.repo AS repo, r.file_path AS file_path, r.content AS content, r.language AS language FROM f0)"


def files(spark: SparkSession, d: str) -> DataFrame:
    """source_files, one row per file: the latest scan, of several at one time the one with the greatest content."""
    f = table(spark, d, "source_files").where("file_id is not null")
    at = ["scanned_at"] if "scanned_at" in f.columns else []
    last = F.max_by(F.struct("repo", "file_path", "content", "language"), F.struct(*at, F.coalesce("content", F.lit(""))))
    return f.groupBy("file_id").agg(last.alias("r")).select("file_id", "r.*")


_TOK = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: length(x) > 1)"


@query(f"SELECT doc_id, len({_TOK.format('text')}) AS n_tokens, len(list_distinct({_TOK.format('text')})) AS n_terms, len(regexp_extract_all(text, '[^\\x{{9}}-\\x{{D}} ]+')) AS n_words FROM documents WHERE text IS NOT NULL")
def text_tokens(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(t.tokens("text")).cast("long").alias("n_tokens"), F.size(F.array_distinct(t.tokens("text"))).cast("long").alias("n_terms"), F.size(F.regexp_extract_all("text", F.lit("([^\\t-\\r ]+)"), 1)).cast("long").alias("n_words"))


_STRIP = "content"
for _p in (r"//[^\n]*", "#[^\\n]*", r"(?s)/\*.*?\*/", '(?s)""".*?"""', "(?s)''''''.*?''''''"):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '', 'g')"
_PLAIN = f"trim(regexp_replace({_STRIP}, '[\\t\\n\\f\\r ]+|\\x{{B}}+', ' ', 'g'))"


@query(f"WITH {_FILES} SELECT file_id, substr(sha256({_PLAIN}), 1, 16) AS hash, length({_PLAIN}) AS n_chars FROM f WHERE content IS NOT NULL")
def code_normalised(spark, d):
    plain = t.normalise_code("content")
    return files(spark, d).where("content is not null").select("file_id", t.sha16(plain).alias("hash"), F.length(plain).cast("long").alias("n_chars"))


_SKELETON = f"trim(regexp_replace(array_to_string(list_transform(list_filter(string_split({_STRIP}, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(?:console\\.\\w+|logger?\\.\\w+|log\\.\\w+|print(?:ln|f)?|fmt\\.Print\\w*|System\\.out\\.\\w+)\\s*\\(')), lambda x: rtrim(x, ' ')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'))"


@query(f"WITH {_FILES}, k AS (SELECT file_id, content, {_SKELETON} AS skeleton FROM f WHERE content IS NOT NULL) SELECT file_id, skeleton, length(skeleton) < 0.8 * length(content) AS worth FROM k")
def code_skeletons(spark, d):
    return files(spark, d).where("content is not null").select("file_id", t.skeleton("content").alias("skeleton"), t.skeleton_is_worth("content").alias("worth"))


_DEC = r"\b(?:if|for|while|case|catch|switch)\b|&&|\|\||\?\?|\?(?:[^.?:]|$)"


@query(
    f"""WITH {_FILES} SELECT file_id, len(string_split(content, chr(10))) AS n_lines,
1 + CASE WHEN lower(language) = 'python' THEN len(regexp_extract_all(content, '{t.DECISIONS_PYTHON}')) ELSE len(regexp_extract_all(content, '\\b(?:if|for|while|case|catch|switch)\\b|&&|\\|\\|')) END AS complexity
FROM f WHERE content IS NOT NULL"""
)
def code_complexity(spark, d):
    plain = r"\b(?:if|for|while|case|catch|switch)\b|&&|\|\|"
    n = F.when(F.lower("language") == "python", F.regexp_count("content", F.lit(t.DECISIONS_PYTHON))).otherwise(F.regexp_count("content", F.lit(plain)))
    return files(spark, d).where("content is not null").select("file_id", t.count_lines("content").cast("long").alias("n_lines"), (1 + n).cast("long").alias("complexity"))


_EXT = "lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))"
_LANG = f"CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.LANGUAGES.items()) + " ELSE 'unknown' END"
_FLAG = "regexp_matches({0}, '{1}')"


@query(
    f"""WITH {_FILES}, g AS (SELECT *, list_extract(string_split(file_path, '/'), -1) AS name FROM f)
SELECT file_id, {_EXT} AS extension, {_LANG} AS language, name, len(string_split(file_path, '/')) - 1 AS depth, regexp_replace(file_path, '/[^/]*$', '') AS directory,
regexp_matches(file_path, '(^|/)(test|tests|__tests__|spec|specs)/') OR regexp_matches(name, '[.](test|spec)[.][^.]+$') OR regexp_matches(name, '_(test|spec)[.][^.]+$') OR regexp_matches(name, '^(test|spec)_.*[.][^.]+$') AS is_test,
regexp_matches(name, '^[.].*rc([.](js|json|yaml|yml))?$') OR contains(name, 'config.') OR contains(name, 'settings.') OR regexp_matches(name, '^tsconfig.*[.]json$') OR name IN ('package.json', 'pyproject.toml', 'Cargo.toml', 'go.mod', 'Gemfile', 'composer.json') AS is_config,
ends_with(name, '.d.ts') OR ends_with(name, '.generated.ts') OR ends_with(name, '.generated.js') OR contains(file_path, '/generated/') OR contains(file_path, '/__generated__/') AS is_generated,
lower(regexp_replace(name, '[.][^.]*$', '')) IN ('index', 'main', 'app', 'server', 'cli', 'entry') OR (len(string_split(file_path, '/')) = 2 AND string_split(file_path, '/')[1] IN ('src', 'lib', 'bin')) AS is_entry_point FROM g"""
)
def path_metadata(spark, d):
    p = t.path_flags("file_path")
    return files(spark, d).select(
        "file_id", t.extension("file_path").alias("extension"), t.language_of("file_path").alias("language"), t.base_name("file_path").alias("name"), (F.size(F.split("file_path", "/")) - 1).cast("long").alias("depth"),
        t.directory("file_path").alias("directory"), p["is_test"].alias("is_test"), p["is_config"].alias("is_config"), p["is_generated"].alias("is_generated"), p["is_entry_point"].alias("is_entry_point"),
    )


_WORDS = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"""SELECT DISTINCT id, array_to_string({_WORDS}, '-') AS kebab, array_to_string(list_transform({_WORDS}, lambda x: upper(x[1]) || x[2:]), '') AS pascal,
regexp_replace(regexp_replace(lower(file_path), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM nodes WHERE name IS NOT NULL""")
def name_forms(spark, d):
    return table(spark, d, "nodes").where("name is not null").select("id", t.kebab("name").alias("kebab"), t.pascal("name").alias("pascal"), t.slug("file_path").alias("slug")).distinct()


@query("""SELECT doc_id, CAST(ceil((length(text) - len(regexp_extract_all(text, '[{}()\\[\\];:=<>+\\-*/&|!?.,''"`@#$%^\\\\~]'))) / 4 + len(regexp_extract_all(text, '[{}()\\[\\];:=<>+\\-*/&|!?.,''"`@#$%^\\\\~]')) / 2) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL""")
def text_token_estimate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", t.estimate_tokens("text").cast("long").alias("tokens"))


@query(f"""WITH {_FILES}, p AS (SELECT file_id, {_PLAIN} AS plain, content FROM f WHERE content IS NOT NULL AND len(string_split(content, chr(10))) >= 5),
q AS (SELECT * FROM p WHERE len(regexp_extract_all(plain, '[^\\x{{9}}-\\x{{D}} ]+')) >= 10), g AS (SELECT plain FROM q GROUP BY plain HAVING count(*) >= 2)
SELECT file_id, 'exact' AS kind, substr(sha256(plain), 1, 16) AS group_id FROM q WHERE plain IN (SELECT plain FROM g)""")
def clones_exact(spark, d):
    return clones.clone_groups(files(spark, d), "file_id", "content").where("kind = 'exact'")


@query(None)
def clones_exact_and_renamed(spark, d):
    """Functions that are copies of others: exact, renamed or near. Whole files are compared by clones_of_files."""
    u = codegraph.function_units(files(spark, d))
    u = cut(u.withColumn("id", F.concat_ws(":", "file_id", "start", "name")))
    groups = cut(clones.clone_groups(u, "id", "code"))
    every = groups.unionByName(clones.near_groups(u, "id", "code", groups))
    return every.join(u.select("id", "file_id", "name", "class_name", "start_line", "end_line"), "id").select("file_id", "name", "class_name", "start_line", "end_line", "kind", "group_id")


@query(None)
def clones_of_files(spark, d):
    return clones.clone_groups(files(spark, d), "file_id", "content")


_ONE = r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_UNI = f"regexp_extract_all(regexp_replace(lower(text), '({_ONE})', ' \\1 ', 'g'), '{_ONE}|[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
_SH = f"""t AS (SELECT doc_id AS id, text, {_UNI} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE w END)) AS s, CASE WHEN len(w) = 0 THEN text END AS x FROM t),
c AS (SELECT s, x, min(id) AS class_id FROM s GROUP BY s, x), m AS (SELECT s.id, c.class_id, c.s FROM s JOIN c ON c.s = s.s AND c.x IS NOT DISTINCT FROM s.x),
o AS (SELECT class_id, s FROM c WHERE len(s) > 0),
g AS (SELECT class_id, len(s) AS n, unnest(s) AS g FROM o), i AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.class_id < b.class_id GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM i WHERE k >= 0.8 * (na + nb - k) - 1e-9), n AS (SELECT class_id, count(*) AS n_links FROM (SELECT a AS class_id FROM l UNION ALL SELECT b FROM l) u GROUP BY 1)"""


@query(f"WITH {_SH} SELECT m.id AS doc_id, m.class_id, coalesce(n.n_links, 0) AS n_links FROM m LEFT JOIN n ON n.class_id = m.class_id")
def clones_similar_documents(spark, d):
    return clones.similar_texts(table(spark, d, "documents"), "doc_id", "text")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose id is divisible by 100, as a query."""
    return table(spark, d, "documents").where("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where("is_external = 0").select("id", retrieval.function_text().alias("text")).distinct()


_TASKS_SQL = "tasks AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL)"
_FUN = "docs AS (SELECT DISTINCT id, concat_ws(chr(10), '[' || coalesce(language, '') || '] ' || coalesce(file_path, '') || ' ' || concat_ws('.', class_name, name), signature, docstring) AS text FROM nodes WHERE is_external = 0)"
_BM25 = f"""k AS (SELECT id, {_TOK.format('text')} AS t FROM docs), st AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS al FROM k),
po AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM k), p AS (SELECT id, dl, term, count(*) AS tf FROM po GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
qt AS (SELECT query_id, unnest({_TOK.format('query')}) AS term FROM tasks), q AS (SELECT query_id, term, count(*) AS qn FROM qt GROUP BY 1, 2),
sc AS (SELECT q.query_id, p.id, round(sum(q.qn * ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / st.al))), 6) AS score FROM q JOIN p ON p.term = q.term JOIN df ON df.term = q.term CROSS JOIN st GROUP BY 1, 2),
bm AS (SELECT CAST(query_id AS BIGINT) AS query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc WHERE score > 0)"""


@query(f"WITH {_TASKS_SQL}, {_FUN}, {_BM25} SELECT * FROM bm WHERE rank <= 10")
def search_functions(spark, d):
    return retrieval.bm25(_functions(spark, d), "id", "text", _tasks(spark, d))


_SPECS = "docs AS (SELECT doc_id AS id, text FROM documents WHERE doc_kind = 'spec')"


@query(f"WITH {_TASKS_SQL}, {_SPECS}, {_BM25} SELECT * FROM bm WHERE rank <= 10")
def search_specs(spark, d):
    specs = table(spark, d, "documents").where("doc_kind = 'spec'").select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25(specs, "id", "text", _tasks(spark, d))


_NEAR = """e AS (SELECT vec_id AS id, embedding AS v FROM embeddings), nn AS (SELECT a.id AS query_id, b.id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS distance
FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0), nr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM nn)"""


@query(f"WITH {_NEAR} SELECT * FROM nr WHERE rank <= 10")
def search_nearest_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.nearest(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"))


@query(f"""WITH tasks AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
docs AS (SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)), {_BM25}, {_NEAR},
dn AS (SELECT query_id, id, 1.0 / (60 + rank) AS d FROM nr WHERE rank <= 50), sp AS (SELECT query_id, id, 1.0 / (60 + rank) AS s FROM bm WHERE rank <= 50),
fu AS (SELECT coalesce(dn.query_id, sp.query_id) AS query_id, coalesce(dn.id, sp.id) AS id, round(coalesce(d, 0) + coalesce(s, 0), 9) AS score FROM dn FULL JOIN sp ON sp.query_id = dn.query_id AND sp.id = dn.id),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fu) SELECT * FROM fr WHERE rank <= 10""")
def search_hybrid(spark, d):
    e = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").join(e.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    q = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    sparse = retrieval.bm25(docs, "doc_id", "text", q, k=50).select("query_id", "id", "rank")
    dense = retrieval.nearest(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), 50)
    return retrieval.fuse(dense, sparse)


@query("""WITH c AS (SELECT DISTINCT candidate_id, request_id, semantic_score, fan_in, fan_out, is_hub, is_entry_point FROM insertion_candidates),
r AS (SELECT *, CASE WHEN is_entry_point THEN 'entry_point' WHEN is_hub THEN 'hub' WHEN fan_out >= 5 THEN 'orchestrator' WHEN fan_in <= 1 THEN 'utility' ELSE 'internal' END AS role, coalesce(semantic_score / max(semantic_score) OVER (PARTITION BY request_id), 0.0) AS share FROM c),
s AS (SELECT *, round(0.6 * least(greatest(share, 0.0), 1.0) + 0.4 * CASE role WHEN 'entry_point' THEN 1.0 WHEN 'orchestrator' THEN 0.8 WHEN 'hub' THEN 0.6 WHEN 'internal' THEN 0.4 ELSE 0.3 END, 6) AS composite FROM r)
SELECT candidate_id, request_id, role, CASE role WHEN 'entry_point' THEN 'extend_entry_point' WHEN 'orchestrator' THEN 'add_orchestration_step' WHEN 'hub' THEN 'cross_cutting_hook' WHEN 'utility' THEN 'extract_shared_logic' ELSE 'call_alongside' END AS strategy,
composite, CAST(row_number() OVER (PARTITION BY request_id ORDER BY composite DESC, candidate_id) AS INTEGER) AS rank FROM s""")
def insertion_points(spark, d):
    return retrieval.insertion_points(table(spark, d, "insertion_candidates"))
