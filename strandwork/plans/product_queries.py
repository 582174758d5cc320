"""Queries over files, functions, changes and documents that lists and reports are made of, with their SQL written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.functions import text as t
from strandwork.operators import callgraph, extract, products, routes
from strandwork.plans.graph_queries import _DEG, _FILES, _TESTS
from strandwork.plans.source_queries import _CUT, _HEADS
from strandwork.plans.text_queries import _FILES as _SOURCES
from strandwork.plans.text_queries import files
from strandwork.sources import files as src
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


# -- source trees --------------------------------------------------------------------------------------------------

_ENDS = "lock|lockb|min[.]js|min[.]css|bundle[.]js|chunk[.]js|map|png|jpg|jpeg|gif|svg|ico|webp|bmp|woff|woff2|ttf|eot|otf|mp3|mp4|wav|avi|mov|webm|pdf|doc|docx|xls|xlsx|zip|tar|gz|rar|7z|pyc|pyo|class|o|so|dll|exe"


@query(f"""WITH {_SOURCES}, s AS (SELECT *, string_split(file_path, '/') AS p FROM f)
SELECT file_id, len(p) - 1 AS depth, len(string_split(content, chr(10))) AS n_lines, starts_with(content, '#!') AS has_shebang,
len(list_intersect(p[1:len(p) - 1], ['node_modules', 'dist', 'build', 'out', 'target', 'bin', 'obj', '__pycache__', 'coverage', 'vendor', 'storybook-static', 'cdk.out', 'android', 'ios'])) > 0
OR len(list_filter(p[1:len(p) - 1], lambda x: starts_with(x, '.') AND x NOT IN ('.github', '.gitlab', '.circleci', '.azure'))) > 0 OR len(list_intersect(p[2:len(p) - 1], ['deps', 'packages'])) > 0
OR regexp_matches(lower(p[len(p)]), '[.]({_ENDS})$') OR p[len(p)] IN ('package-lock.json', 'pnpm-lock.yaml', 'yarn.lock', '.DS_Store', 'Thumbs.db') AS skipped,
regexp_matches(file_path, '^packages/[^/]*/src/(drift|cli)/') AND NOT regexp_matches(file_path, '[.]ts$') AS ignored FROM s WHERE content IS NOT NULL""")
def tree_files(spark, d):
    """What a walk says of each file: depth, lines, shebang, whether it is skipped, whether two globs leave it out."""
    f = files(spark, d).where("content is not null")
    globs = t.matches_any("file_path", ["packages/*/src/drift/**", "packages/*/src/cli/**"]) & ~t.matches_any("file_path", ["**/*.ts"])
    return f.select(
        "file_id", (F.size(F.split("file_path", "/")) - 1).cast("long").alias("depth"), t.count_lines("content").cast("long").alias("n_lines"), F.col("content").startswith("#!").alias("has_shebang"),
        src.skipped(F.col("file_path")).alias("skipped"), globs.alias("ignored"),
    )


@query(f"""WITH {_SOURCES}, p AS (SELECT file_path, list_filter(string_split(lower(file_path), '/'), lambda x: x <> '' AND x NOT IN ('src', 'lib', 'app', 'core', 'common', 'shared', 'utils', 'helpers', 'config') AND NOT starts_with(x, '.'))[1] AS domain,
regexp_replace(list_extract(string_split(file_path, '/'), -1), '[.][^.]+$', '') AS stem, list_extract(string_split(file_path, '/'), -1) AS name FROM (SELECT DISTINCT file_path FROM f) u),
k AS (SELECT * FROM p WHERE NOT regexp_matches(file_path, '{_TESTS}') AND NOT (regexp_matches(name, '^[.].*rc([.](js|json|yaml|yml))?$') OR contains(name, 'config.') OR contains(name, 'settings.') OR regexp_matches(name, '^tsconfig.*[.]json$') OR name IN ('package.json', 'pyproject.toml', 'Cargo.toml', 'go.mod', 'Gemfile', 'composer.json'))),
n AS (SELECT lower(regexp_extract(stem, '^([^-_.]*)', 1)) AS domain, file_path FROM k WHERE regexp_matches(stem, '[-_.]')),
e AS (SELECT domain, file_path FROM k WHERE domain IS NOT NULL UNION ALL SELECT domain, file_path FROM n WHERE length(domain) > 2 AND domain NOT IN ('src', 'lib', 'app', 'core', 'common', 'shared', 'utils', 'helpers', 'config') AND domain NOT IN (SELECT domain FROM k WHERE domain IS NOT NULL))
SELECT domain, file_path FROM e WHERE domain IN (SELECT domain FROM e GROUP BY 1 HAVING count(*) >= 2)""")
def file_domains(spark, d):
    return products.inferred_domains(files(spark, d))


_DOMAINS = "dm AS (SELECT DISTINCT list_extract(string_split(file_path, '/'), 4) AS domain FROM nodes WHERE is_external = 0 AND file_path IS NOT NULL AND len(string_split(file_path, '/')) >= 4)"


@query(f"""WITH {_SOURCES}, {_DOMAINS}, p AS (SELECT DISTINCT file_path, string_split(lower(file_path), '/') AS s FROM f), q AS (SELECT *, regexp_replace(s[len(s)], '[.][^.]+$', '') AS stem FROM p),
h AS (SELECT file_path, domain FROM q, dm WHERE list_contains(s, lower(domain)) OR stem = lower(domain) OR (starts_with(stem, lower(domain)) AND substr(stem, length(domain) + 1, 1) IN ('-', '_', '.')))
SELECT file_path, arg_min(domain, (-length(domain), domain)) AS domain FROM h GROUP BY 1""")
def file_known_domains(spark, d):
    """The domain of each file among those that the call graph's files have."""
    dm = table(spark, d, "nodes").where("is_external = 0").select(F.try_element_at(F.split("file_path", "/"), F.lit(4)).alias("domain")).where("domain is not null")
    return products.known_domains(files(spark, d), dm)


@query(f"""WITH {_SOURCES}, p AS (SELECT DISTINCT file_path, regexp_replace(file_path, '/[^/]*$', '') AS dir FROM f), q AS (SELECT *, list_extract(list_filter(string_split(lower(dir), '/'), lambda x: x NOT IN ('', 'src', 'lib', 'app')), -1) AS seg FROM p)
SELECT file_path, CASE WHEN seg IN ('api', 'routes', 'endpoint', 'endpoints') THEN 'api' WHEN seg IN ('model', 'models', 'entities', 'schema', 'schemas') THEN 'domain' WHEN seg IN ('service', 'services') THEN 'services' WHEN seg IN ('controller', 'controllers') THEN 'controllers'
WHEN seg IN ('util', 'utils', 'helper', 'helpers', 'common') THEN 'utilities' WHEN seg IN ('component', 'components') THEN 'components' WHEN seg IN ('hook', 'hooks') THEN 'hooks' WHEN seg IN ('auth', 'authentication') THEN 'authentication' WHEN seg IN ('user', 'users') THEN 'users'
WHEN seg IN ('product', 'products') THEN 'products' WHEN seg IN ('order', 'orders') THEN 'orders' WHEN seg IN ('payment', 'payments') THEN 'payments' WHEN seg = 'core' THEN 'core' ELSE regexp_replace(seg, '[^a-z0-9]', '-', 'g') END AS folder,
CASE WHEN regexp_matches(file_path, '(?i)/(component|components|view|views|page|pages|ui|screen|screens|layout|layouts)/|[.](jsx|tsx|vue)$|[.](component|page)[.]') THEN 'presentation'
WHEN regexp_matches(file_path, '(?i)/(service|services|domain|business|core|logic|usecase|usecases)/|[.](service|usecase)[.]') THEN 'business'
WHEN regexp_matches(file_path, '(?i)/(model|models|entitie|entities|repositorie|repositories|schema|schemas|db|database|data)/|[.]model[.]') THEN 'data' END AS layer FROM q""")
def file_layers(spark, d):
    f = files(spark, d).select("file_path").distinct()
    return f.select("file_path", products.folder_domain(t.directory("file_path")).alias("folder"), products.layer_of(F.col("file_path")).alias("layer"))


@query(f"""WITH {_SOURCES}, p AS (SELECT DISTINCT file_path, lower(regexp_extract(file_path, '([^/]*)/[^/]*$', 1)) AS dir, list_extract(string_split(file_path, '/'), -1) AS name FROM f),
a AS (SELECT count(*) AS n, sum(CASE WHEN name = 'package.json' THEN 1 ELSE 0 END) AS packs, bool_or(contains(name, 'docker-compose')) AS comp, bool_or(dir IN ('modules', 'features', 'domains')) AS modu,
max(CAST(contains(dir, 'controllers') AS INTEGER)) + max(CAST(contains(dir, 'services') AS INTEGER)) + max(CAST(contains(dir, 'repositories') AS INTEGER)) + max(CAST(contains(dir, 'routes') AS INTEGER)) + max(CAST(contains(dir, 'models') AS INTEGER)) + max(CAST(contains(dir, 'views') AS INTEGER)) AS lay FROM p)
SELECT CASE WHEN packs > 1 AND comp THEN 'microservices' WHEN modu THEN 'modular' WHEN lay >= 3 THEN 'layered' WHEN n < 50 THEN 'monolith' ELSE 'unknown' END AS pattern FROM a""")
def architecture_pattern(spark, d):
    return products.architecture_pattern(files(spark, d))


@query(_FILES + f""", {_SOURCES}, dg AS (SELECT file, sum(1) AS c FROM (SELECT target AS file FROM l UNION ALL SELECT source FROM l) x GROUP BY 1),
pf AS (SELECT DISTINCT file_path, len(string_split(content, chr(10))) AS n_lines, list_filter(string_split(lower(file_path), '/'), lambda x: x <> '' AND x NOT IN ('src', 'lib', 'app', 'core', 'common', 'shared', 'utils', 'helpers', 'config') AND NOT starts_with(x, '.'))[1] AS domain FROM f WHERE content IS NOT NULL),
k AS (SELECT pf.domain, pf.file_path, CAST(coalesce(c, 0) AS BIGINT) AS connectivity FROM pf LEFT JOIN dg ON dg.file = pf.file_path WHERE n_lines BETWEEN 50 AND 500 AND domain IS NOT NULL AND regexp_matches(pf.file_path, '(?i)[.](ts|tsx|js|jsx|py|go|rs|rb|java|cpp|c|cs|swift|kt)$')
AND NOT regexp_matches(pf.file_path, '{_TESTS}') AND NOT regexp_matches(pf.file_path, '[.]d[.]ts$|[.]generated[.](ts|js)$|/generated/|/__generated__/')),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain ORDER BY connectivity DESC, file_path) AS INTEGER) AS rank FROM k) SELECT * FROM r WHERE rank <= 3""")
def verification_candidates(spark, d):
    f = files(spark, d).where("content is not null").select("file_path", t.count_lines("content").alias("lines"))
    return products.verification_candidates(f, callgraph.file_degrees(callgraph.file_edges(table(spark, d, "edges"))))


@query(_FILES + " SELECT source AS file, 'imports' AS direction, target AS other, n_calls FROM l UNION ALL SELECT target, 'importedBy', source, n_calls FROM l")
def file_dependencies(spark, d):
    """Files with the files they lean on and those that lean on them."""
    e = callgraph.file_edges(table(spark, d, "edges"))
    return e.select(F.col("source").alias("file"), F.lit("imports").alias("direction"), F.col("target").alias("other"), "n_calls").unionByName(
        e.select(F.col("target").alias("file"), F.lit("importedBy").alias("direction"), F.col("source").alias("other"), "n_calls")
    )


_JSFILES = "lower(regexp_extract(file_path, '[.]([A-Za-z0-9]+)$', 1)) IN ('ts', 'tsx', 'mts', 'js', 'jsx', 'mjs', 'cjs')"


@query(rf"""WITH {_SOURCES}, m AS (SELECT file_id, unnest(regexp_extract_all(content, '(?m)^[ \t]*import\s+(?:type\s+)?(?:\w+\s*,\s*)?(\{{[^}}]*\}}\s*from\s*[''"][^''"]+[''"])', 1)) AS m FROM f WHERE content IS NOT NULL AND {_JSFILES}),
p AS (SELECT file_id, regexp_extract(m, 'from\s*[''"]([^''"]+)[''"]$', 1) AS source, regexp_replace(trim(regexp_replace(unnest(string_split(regexp_extract(m, '^\{{([^}}]*)\}}', 1), ',')), '\s+', ' ', 'g')), '^type ', '') AS p FROM m)
SELECT file_id, source, regexp_extract(p, '^([A-Za-z0-9_$]+)', 1) AS name, regexp_extract(p, '([A-Za-z0-9_$]+)$', 1) AS local FROM p WHERE regexp_extract(p, '^([A-Za-z0-9_$]+)', 1) <> ''""")
def imported_names(spark, d):
    return extract.imported_names(files(spark, d))


_PACKAGES = rf"""pk AS (SELECT file_id, file_path, regexp_extract(content, '(?m)^[ \t]*package[ \t]+([A-Za-z0-9_.]+)', 1) AS package FROM f WHERE content IS NOT NULL AND lower(regexp_extract(file_path, '[.]([A-Za-z0-9]+)$', 1)) IN ('java', 'go'))"""


@query(f"WITH {_SOURCES}, {_PACKAGES} SELECT * FROM pk WHERE package <> ''")
def declared_packages(spark, d):
    return extract.declared_packages(files(spark, d))


@query(rf"""WITH {_SOURCES}, {_PACKAGES}, i AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '(?m)^import[ \t]+(?:static[ \t]+)?([A-Za-z0-9_.]+(?:\.\*)?);', 1)) AS source FROM f WHERE content IS NOT NULL AND lower(regexp_extract(file_path, '[.]([A-Za-z0-9]+)$', 1)) = 'java'),
o AS (SELECT package || '.' || regexp_extract(file_path, '([^/]*)[.][^./]*$', 1) AS source, file_id AS target_id FROM pk WHERE package <> '' AND lower(file_path) LIKE '%.java') SELECT i.file_id, i.source, min(target_id) AS target_id FROM i JOIN o ON o.source = i.source GROUP BY 1, 2""")
def resolved_java_imports(spark, d):
    return extract.resolved_java_imports(files(spark, d))


# -- functions -----------------------------------------------------------------------------------------------------


def _kinds_sql() -> str:
    base = "regexp_replace(lower(string_split(name, '.')[1]), '[^a-z0-9]', '', 'g')"
    each = " ".join(f"WHEN {base} IN ({', '.join(repr(w) for w in words)}) THEN '{kind}'" for kind, words in products.EXTERNAL.items())
    return f"CASE {each} WHEN contains(name, '.') AND lower(string_split(name, '.')[1]) IN ({', '.join(repr(w) for w in products.NOISE)}) THEN 'stdlib' ELSE 'unknown' END"


@query(f"SELECT DISTINCT id, name, {_kinds_sql()} AS kind FROM nodes WHERE is_external = 1 AND name IS NOT NULL UNION SELECT DISTINCT callee_id, callee_name, {_kinds_sql().replace('name', 'callee_name')} FROM edges WHERE confidence = 'external' AND callee_name IS NOT NULL AND callee_id IS NOT NULL")
def external_kinds(spark, d):
    """What kind of library each external node and each call that was resolved to none leads to."""
    n = table(spark, d, "nodes").where("is_external = 1 and name is not null").select("id", "name")
    e = table(spark, d, "edges").where("confidence = 'external' and callee_name is not null and callee_id is not null").select(F.col("callee_id").alias("id"), F.col("callee_name").alias("name"))
    return n.unionByName(e).distinct().withColumn("kind", products.external_kind(F.col("name")))


_ARITY = "regexp_extract(signature, '^[^(]*[(](.*)$', 1)"
for _ in range(4):
    _ARITY = f"regexp_replace({_ARITY}, '[(][^()]*[)]|\\[[^\\[\\]]*\\]|\\{{[^{{}}]*\\}}|<[^<>]*>', '', 'g')"


@query(f"""SELECT DISTINCT id, coalesce(name, '') AS name, coalesce(language, '') AS language, coalesce(fan_in, 0) AS fan_in, NOT starts_with(name, '_') AS is_public,
CASE WHEN contains(signature, '(') THEN len(list_filter(string_split(string_split({_ARITY}, ')')[1], ','), lambda x: trim(x) <> '')) END AS arity FROM nodes WHERE is_external = 0""")
def node_summaries(spark, d):
    n = table(spark, d, "nodes").where("is_external = 0")
    return n.select(
        "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"), products.is_public(F.col("name")).alias("is_public"),
        products.arity(F.col("signature")).cast("long").alias("arity"),
    ).distinct()


@query(f"WITH {_SOURCES}, n AS (SELECT DISTINCT id, file_path, start_index AS s, end_index AS e FROM nodes WHERE is_external = 0 AND start_index IS NOT NULL AND end_index IS NOT NULL) SELECT id, f.file_id, substr(content, s + 1, e - s) AS body FROM n JOIN f ON f.file_path = n.file_path WHERE content IS NOT NULL")
def function_bodies(spark, d):
    """The text of every function, cut from its file by the stored places."""
    n = table(spark, d, "nodes").where("is_external = 0 and start_index is not null and end_index is not null").select("id", "file_path", "start_index", "end_index").distinct()
    f = files(spark, d).where("content is not null").select("file_id", "file_path", "content")
    return n.join(f, "file_path").select("id", "file_id", F.substr("content", F.col("start_index") + 1, F.col("end_index") - F.col("start_index")).alias("body"))


@query("""SELECT DISTINCT n.id, c.signature FROM (SELECT DISTINCT id, name, file_path FROM nodes WHERE is_external = 0) n
LEFT JOIN (SELECT file_path, name, min(signature) AS signature FROM insertion_candidates WHERE signature IS NOT NULL GROUP BY 1, 2) c ON c.file_path = n.file_path AND c.name = n.name""")
def node_signatures(spark, d):
    """Each function with the signature that a candidate of the same file and name has, the first of several."""
    n = table(spark, d, "nodes").where("is_external = 0").select("id", "name", "file_path").distinct()
    c = table(spark, d, "insertion_candidates").where("signature is not null").groupBy("file_path", "name").agg(F.min("signature").alias("signature"))
    return n.join(c, ["file_path", "name"], "left").select("id", "signature").distinct()


@query("""SELECT DISTINCT candidate_id, file_path, name FROM insertion_candidates c WHERE candidate_id IS NOT NULL AND file_path IS NOT NULL AND name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.is_external = 0 AND n.file_path = c.file_path AND n.name = c.name)""")
def signatures_without_node(spark, d):
    c = table(spark, d, "insertion_candidates").where("candidate_id is not null and file_path is not null and name is not null").select("candidate_id", "file_path", "name").distinct()
    return c.join(table(spark, d, "nodes").where("is_external = 0").select("file_path", "name"), ["file_path", "name"], "left_anti").select("candidate_id", "file_path", "name")


@query(f"""WITH e AS (SELECT edge_id, arg_max({{'a': caller_file, 'b': callee_id}}, (loaded_at, caller_id, callee_id, caller_file, callee_file, kind, call_type)) AS r FROM edges WHERE edge_id IS NOT NULL GROUP BY 1),
n AS (SELECT DISTINCT id FROM nodes WHERE is_external = 0 AND NOT coalesce(regexp_matches(file_path, '{_TESTS}'), false))
SELECT DISTINCT r.b AS callee_id, r.a AS test_file, 'called' AS confidence FROM e WHERE regexp_matches(r.a, '{_TESTS}') AND r.b IN (SELECT id FROM n)""")
def graph_tested_by(spark, d):
    """Functions with the test files that call them."""
    e = callgraph.one_edge_each(table(spark, d, "edges"))
    return callgraph.tested_by(e, table(spark, d, "nodes"))


@query(_DEG + """, x AS (SELECT id, fan_in, fan_out, CAST(least(100, floor(4 * fan_in + 2 * fan_out + CASE WHEN fan_in >= 5 THEN 20 ELSE 0 END + 0.5)) AS INTEGER) AS risk FROM d WHERE is_external = 0)
SELECT id, risk, CASE WHEN risk < 40 THEN 'low' WHEN risk < 70 THEN 'medium' WHEN risk < 85 THEN 'high' ELSE 'critical' END AS badge,
CASE WHEN risk <= 20 THEN 'refactor freely' WHEN risk <= 45 THEN 'refactor with tests' WHEN fan_in >= 5 AND fan_out > 5 THEN 'split responsibility' WHEN fan_in >= 5 THEN 'introduce facade' WHEN fan_out > 8 THEN 'decompose fan-out' ELSE 'incremental extraction' END AS approach FROM x""")
def refactoring_approaches(spark, d):
    """Risk of each function by its own links, its badge and what to do with it."""
    n = callgraph.with_degrees(table(spark, d, "nodes"), table(spark, d, "edges")).where("is_external = 0")
    risk = F.least(F.lit(100), F.floor(4 * F.col("fan_in") + 2 * F.col("fan_out") + F.when(F.col("fan_in") >= 5, 20).otherwise(0) + F.lit(0.5))).cast("int")
    return n.withColumn("risk", risk).select("id", "risk", products.risk_badge(F.col("risk")).alias("badge"), products.refactoring_approach(F.col("risk"), F.col("fan_out"), F.col("fan_in") >= 5).alias("approach"))


@query("SELECT count(DISTINCT id) AS n_functions, count(DISTINCT file_path) AS n_files, count(DISTINCT regexp_replace(file_path, '/[^/]*$', '')) AS n_modules, round(avg(fan_out), 1) AS avg_fan_out FROM (SELECT DISTINCT id, file_path, fan_out FROM nodes WHERE is_external = 0) n")
def tree_statistics(spark, d):
    return products.tree_statistics(table(spark, d, "nodes"))


@query("SELECT CASE WHEN trim(coalesce(language, '')) = '' THEN 'unknown' ELSE lower(trim(language)) END AS language, count(DISTINCT file_path) AS n_files, count(DISTINCT id) AS n_functions FROM nodes WHERE is_external = 0 GROUP BY 1")
def language_statistics(spark, d):
    return products.language_statistics(table(spark, d, "nodes"))


@query(_DEG + ", g AS (SELECT file_path, id, fan_out FROM d WHERE is_external = 0 AND fan_out >= 8), m AS (SELECT file_path, count(*) AS n, max(fan_out) AS greatest FROM g GROUP BY 1) SELECT file_path, n, greatest FROM m")
def file_god_functions(spark, d):
    """Files with their functions that call eight others or more."""
    g = callgraph.with_degrees(table(spark, d, "nodes"), table(spark, d, "edges")).where("is_external = 0 and fan_out >= 8")
    return g.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.max("fan_out").alias("greatest"))


@query("SELECT file_path, list_extract(string_split(file_path, '/'), -1) AS name, count(DISTINCT id) AS n_functions, count(DISTINCT class_name) AS n_classes FROM nodes WHERE is_external = 0 AND file_path IS NOT NULL GROUP BY 1")
def graph_nodes_of_files(spark, d):
    """Functions and classes that each file holds."""
    n = table(spark, d, "nodes").where("is_external = 0 and file_path is not null")
    return n.groupBy("file_path").agg(F.count_distinct("id").alias("n_functions"), F.count_distinct("class_name").alias("n_classes")).withColumn("name", t.base_name("file_path"))


# -- the store -----------------------------------------------------------------------------------------------------

_LAST = "(loaded_at, coalesce(caller_id, ''), coalesce(callee_id, ''))"


@query(f"""SELECT edge_id, arg_max(caller_id, {_LAST}) AS caller_id, arg_max(callee_id, {_LAST}) AS callee_id, CASE WHEN contains(arg_max(caller_id, {_LAST}), '::') THEN string_split(arg_max(caller_id, {_LAST}), '::')[1] END AS caller_file FROM edges WHERE edge_id IS NOT NULL AND caller_id IS NOT NULL AND callee_id IS NOT NULL GROUP BY 1""")
def store_edges(spark, d):
    """Edges as stored: the last loaded of an id, the caller's file taken from its id."""
    e = table(spark, d, "edges").where("edge_id is not null and caller_id is not null and callee_id is not null")
    last = e.groupBy("edge_id").agg(F.max_by(F.struct("caller_id", "callee_id"), F.struct("loaded_at", "caller_id", "callee_id")).alias("r")).select("edge_id", "r.*")
    return last.withColumn("caller_file", callgraph.file_of("caller_id"))


@query("SELECT DISTINCT id, name, file_path FROM nodes WHERE id IS NOT NULL AND coalesce(file_path, '') NOT IN (SELECT file_path FROM file_hashes WHERE removed_at IS NOT NULL)")
def store_nodes_of_kept_files(spark, d):
    """Nodes without those of removed files."""
    gone = table(spark, d, "file_hashes").where("removed_at is not null").select("file_path")
    return table(spark, d, "nodes").where("id is not null").select("id", "name", "file_path").distinct().join(gone, "file_path", "left_anti").select("id", "name", "file_path")


@query("""SELECT file_path || '::' || coalesce(class_name, list_extract(string_split(file_path, '/'), -1)) AS class_id, count(DISTINCT id) AS n_methods FROM nodes
WHERE is_external = 0 AND file_path IS NOT NULL AND file_path NOT IN (SELECT file_path FROM file_hashes WHERE removed_at IS NOT NULL) GROUP BY 1""")
def store_classes_of_kept_files(spark, d):
    gone = table(spark, d, "file_hashes").where("removed_at is not null").select("file_path")
    n = table(spark, d, "nodes").where("is_external = 0 and file_path is not null").join(gone, "file_path", "left_anti")
    return n.groupBy(F.concat("file_path", F.lit("::"), F.coalesce("class_name", t.base_name("file_path"))).alias("class_id")).agg(F.count_distinct("id").alias("n_methods"))


@query("SELECT DISTINCT s.file_path, h.content_hash, h.file_path IS NULL AS is_new FROM (SELECT DISTINCT file_path FROM source_files WHERE file_path IS NOT NULL) s LEFT JOIN file_hashes h ON h.file_path = s.file_path")
def store_hash_lookups(spark, d):
    """The stored hash of each scanned file, and whether there is none."""
    s = table(spark, d, "source_files").where("file_path is not null").select("file_path").distinct()
    h = table(spark, d, "file_hashes").select("file_path", "content_hash", F.lit(1).alias("known"))
    return s.join(h, "file_path", "left").select("file_path", "content_hash", F.col("known").isNull().alias("is_new")).distinct()


@query(f"""SELECT DISTINCT s.file_path, CASE WHEN h.file_path IS NULL THEN 'added' WHEN s.t > h.updated_at THEN 'modified' END AS status FROM (SELECT file_path, max(epoch_ms(scanned_at)) AS t FROM source_files WHERE file_path IS NOT NULL GROUP BY 1) s LEFT JOIN file_hashes h ON h.file_path = s.file_path
WHERE h.file_path IS NULL OR s.t > h.updated_at UNION ALL SELECT file_path, 'deleted' FROM file_hashes WHERE file_path NOT IN (SELECT file_path FROM source_files WHERE file_path IS NOT NULL)""")
def store_changes_by_time(spark, d):
    """Files added, modified or deleted since they were stored, by their times."""
    s = table(spark, d, "source_files").where("file_path is not null").groupBy("file_path").agg(F.max(F.unix_millis("scanned_at")).alias("t"))
    h = table(spark, d, "file_hashes").select("file_path", "updated_at", F.lit(1).alias("known"))
    new = s.join(h, "file_path", "left").where("known is null or t > updated_at").select("file_path", F.when(F.col("known").isNull(), "added").otherwise("modified").alias("status")).distinct()
    return new.unionByName(h.join(s, "file_path", "left_anti").select("file_path", F.lit("deleted").alias("status")))


@query("SELECT count(*) AS n_files, max(updated_at) AS last_ms, CAST(sum(CASE WHEN removed_at IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_kept FROM file_hashes")
def store_freshness(spark, d):
    return table(spark, d, "file_hashes").agg(F.count(F.lit(1)).alias("n_files"), F.max("updated_at").alias("last_ms"), F.sum(F.col("removed_at").isNull().cast("int")).alias("n_kept"))


# -- change sets: lines are made from the tables and read back -------------------------------------------------------

_STATUS = f"CASE WHEN removed_at IS NOT NULL THEN 'deleted' WHEN epoch_ms(first_seen_at) >= epoch_ms(TIMESTAMP '{_CUT}') THEN 'added' WHEN updated_at % 5 = 0 THEN 'renamed' ELSE 'modified' END"


def _status():
    return F.when(F.col("removed_at").isNotNull(), "deleted").when(F.col("first_seen_at") >= F.lit(_CUT).cast("timestamp"), "added").when(F.col("updated_at") % 5 == 0, "renamed").otherwise("modified")


@query(f"""SELECT file_path AS path, {_STATUS} AS status, CASE WHEN {_STATUS} = 'renamed' THEN 'old/' || file_path END AS old_path, CAST(length(file_path) AS INTEGER) AS additions, CAST(updated_at % 7 AS INTEGER) AS deletions FROM file_hashes""")
def change_sets(spark, d):
    """A name-status and a numstat listing of all files, written as lines, read back and put together."""
    h = table(spark, d, "file_hashes").withColumn("s", _status())
    old = F.concat(F.lit("old/"), "file_path")
    line = F.when(F.col("s") == "renamed", F.concat(F.lit("R090\t"), old, F.lit("\t"), "file_path")).otherwise(F.concat(F.upper(F.substring("s", 1, 1)), F.lit("\t"), "file_path"))
    stat = F.concat(F.length("file_path").cast("string"), F.lit("\t"), (F.col("updated_at") % 7).cast("string"), F.lit("\t"), F.when(F.col("s") == "renamed", F.concat(old, F.lit(" => "), "file_path")).otherwise(F.col("file_path")))
    status, counts = src.name_status(h.select(line.alias("value"))), src.numstat(h.select(stat.alias("value")))
    return src.changed_files(status, counts).select("path", "status", "old_path", "additions", "deletions")


@query("""WITH e AS (SELECT DISTINCT caller_file AS path, line FROM edges WHERE caller_file IS NOT NULL AND line IS NOT NULL AND line > 0)
SELECT path, CAST(line AS INTEGER) AS start, CAST(line + 2 AS INTEGER) AS "end", CASE line % 3 WHEN 0 THEN 'signature' WHEN 1 THEN 'config' ELSE 'logic' END AS kind FROM e""")
def change_hunks(spark, d):
    """The hunks of a diff of every file with calls, three lines each, with the kind of change; written and read back."""
    e = table(spark, d, "edges").where("caller_file is not null and line > 0").select("caller_file", "line").distinct()
    added = F.when(F.col("line") % 3 == 0, "+export function f(a) {").when(F.col("line") % 3 == 1, "+LIMIT = 3").otherwise("+  go(a)")
    hunk = F.concat(F.lit("@@ -1,2 +"), F.col("line").cast("string"), F.lit(",3 @@\n ctx\n"), added, F.lit("\n"))
    diff = F.concat(F.lit("diff --git a/"), "caller_file", F.lit(" b/"), "caller_file", F.lit("\n--- a/"), "caller_file", F.lit("\n+++ b/"), "caller_file", F.lit("\n"), hunk)
    return src.diff_hunks(e.select(diff.alias("diff"))).select("path", "start", "end", src.change_kind(F.col("added")).alias("kind"))


# -- manifests, calls and names: round trips -------------------------------------------------------------------------


@query("""WITH e AS (SELECT DISTINCT id, name FROM nodes WHERE is_external = 1 AND regexp_matches(name, '^[A-Za-z][A-Za-z0-9]*[.][A-Za-z]+$')), p AS (SELECT DISTINCT string_split(name, '.')[1] AS name, length(string_split(name, '.')[1]) AS v FROM e)
SELECT unnest(['npm', 'pip', 'pip', 'cargo', 'go']) AS ecosystem, unnest([name, name, name, name, 'host.org/x/' || name]) AS package, unnest(['^' || v, '==' || v, '^' || v, '1.' || v, 'v1.' || v || '.0']) AS version, unnest(['package.json', 'requirements.txt', 'pyproject.toml', 'Cargo.toml', 'go.mod']) AS path FROM p""")
def package_manifests(spark, d):
    """Manifests of five kinds that name the external libraries of the call graph, written and read back."""
    n = table(spark, d, "nodes").where("is_external = 1").where(F.col("name").rlike(r"^[A-Za-z][A-Za-z0-9]*\.[A-Za-z]+$")).select(F.split_part("name", F.lit("."), F.lit(1)).alias("name")).distinct().withColumn("v", F.length("name").cast("string"))
    lines = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "\n")  # noqa: E731 - as many as there are libraries
    m = n.agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("name", F.concat(F.lit("^"), "v")))).alias("dependencies"))).alias("package.json"), lines(F.concat("name", F.lit("=="), "v")).alias("requirements.txt"),
        F.concat(F.lit("[tool.poetry.dependencies]\n"), lines(F.concat("name", F.lit(' = "^'), "v", F.lit('"')))).alias("pyproject.toml"), F.concat(F.lit("[dependencies]\n"), lines(F.concat("name", F.lit(' = { version = "1.'), "v", F.lit('" }')))).alias("Cargo.toml"),
        F.concat(F.lit("module m\n"), lines(F.concat(F.lit("require host.org/x/"), "name", F.lit(" v1."), "v", F.lit(".0")))).alias("go.mod"),
    )
    names = ["package.json", "requirements.txt", "pyproject.toml", "Cargo.toml", "go.mod"]
    f = m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("path"), F.col(f"`{k}`").alias("content")) for k in names])).alias("x")).select("x.*")
    return src.packages(f).select("ecosystem", F.col("name").alias("package"), "version", "path")


_URL = "'/' || lower(class_name) || '/' || lower(name)"
_URLS = "class_name IS NOT NULL AND name IS NOT NULL AND is_external = 0"


@query(f"""WITH n AS (SELECT DISTINCT id, class_name, name, start_index % 4 AS k FROM nodes WHERE {_URLS} AND start_index IS NOT NULL),
r AS (SELECT id AS route_id, {_URL} || '/:param' AS q, CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS m2 FROM n), c AS (SELECT id AS call_id, {_URL} || '/:param' AS p, CASE WHEN k = 0 THEN '/api/v1' WHEN k = 1 THEN '/v2' ELSE '' END AS pre, CASE WHEN k = 3 THEN NULL WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS m1 FROM n)
SELECT call_id, route_id, CASE WHEN pre = '' AND m1 = m2 THEN 'exact' ELSE 'path' END AS confidence FROM c JOIN r ON r.q = c.p WHERE m1 = m2 OR m1 IS NULL""")
def http_edges(spark, d):
    """Calls matched with routes: every method serves a route of its name and is called by it, some with a prefix or without
    a method."""
    n = table(spark, d, "nodes").where("class_name is not null and name is not null and is_external = 0 and start_index is not null").select("id", "class_name", "name", (F.col("start_index") % 4).alias("k")).distinct()
    path = F.concat(F.lit("/"), F.col("class_name"), F.lit("/"), "name")
    verb = F.when(F.col("k") % 2 == 0, "get").otherwise("post")
    route = n.select(F.col("id").alias("route_id"), verb.alias("method"), F.concat(path, F.lit("/{id}/")).alias("path"))
    pre = F.when(F.col("k") == 0, "https://h.org/api/v1").when(F.col("k") == 1, "/v2").otherwise("")
    call = n.select(F.col("id").alias("call_id"), F.when(F.col("k") != 3, verb).alias("method"), F.concat(pre, path, F.lit("/${row.id}?x=1")).alias("url"))
    return routes.http_edges(call, route)


@query("""SELECT DISTINCT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS plain, substr(sha256('s:' || file_path || ':' || name), 1, 8) AS decision,
'https://h.org/' || string_split(file_path, '/')[2] AS web, CASE WHEN string_split(file_path, '/')[1] = 'packages' AND len(string_split(file_path, '/')) > 2 THEN string_split(file_path, '/')[2] END AS module FROM nodes WHERE is_external = 0 AND name IS NOT NULL AND file_path IS NOT NULL""")
def name_keys(spark, d):
    """Slugs, letters alone, decision ids, web addresses and modules of functions."""
    n = table(spark, d, "nodes").where("is_external = 0 and name is not null and file_path is not null")
    remote = F.concat(F.lit("git@h.org:"), F.split_part("file_path", F.lit("/"), F.lit(2)), F.lit(".git"))
    return n.select(
        "id", t.slug("name").alias("slug"), t.alphanumeric("name").alias("plain"), t.decision_id(F.lit("s"), F.col("file_path"), F.col("name")).alias("decision"), t.remote_to_web(remote).alias("web"),
        t.module_of("file_path", ("packages",)).alias("module"),
    ).distinct()


@query("""WITH p AS (SELECT DISTINCT c.candidate_id, c.name AS a, n.name AS b FROM insertion_candidates c JOIN nodes n ON n.file_path = c.file_path AND n.is_external = 0 WHERE c.name IS NOT NULL AND n.name IS NOT NULL AND c.candidate_id IS NOT NULL),
w AS (SELECT *, regexp_replace(lower(a), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(b), '[^a-z0-9]', '', 'g') AS y,
list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(a, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda z: z <> '')) AS wa,
list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(b, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda z: z <> '')) AS wb FROM p)
SELECT candidate_id, a, b, round(CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.8 ELSE 0.7 * len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END, 6) AS similarity FROM w""")
def name_similarities(spark, d):
    """Candidates' names against those of the functions of their file."""
    c = table(spark, d, "insertion_candidates").where("candidate_id is not null and name is not null").select("candidate_id", "file_path", F.col("name").alias("a"))
    n = table(spark, d, "nodes").where("is_external = 0 and name is not null").select("file_path", F.col("name").alias("b"))
    return c.join(n, "file_path").select("candidate_id", "a", "b").distinct().withColumn("similarity", F.round(t.similarity("a", "b"), 6))


@query("""WITH c AS (SELECT DISTINCT candidate_id, name, fan_in, fan_out, insertion_strategy AS s FROM insertion_candidates WHERE candidate_id IS NOT NULL AND name IS NOT NULL)
SELECT candidate_id, CASE s WHEN 'extend_entry_point' THEN name || ' is an entry point; extend it or put another beside it' WHEN 'add_orchestration_step' THEN name || ' runs ' || fan_out || ' calls; add a step'
WHEN 'cross_cutting_hook' THEN name || ' is called from ' || fan_in || ' places; a hook here reaches all' WHEN 'extract_shared_logic' THEN name || ' is little used; shared logic can live here' ELSE name || ' is close to the task; call alongside it' END AS why FROM c""")
def insertion_reasons(spark, d):
    c = table(spark, d, "insertion_candidates").where("candidate_id is not null and name is not null").select("candidate_id", "name", "fan_in", "fan_out", "insertion_strategy").distinct()
    return c.select("candidate_id", products.insertion_reason(F.col("name"), F.col("insertion_strategy"), F.col("fan_in"), F.col("fan_out")).alias("why"))


@query("""WITH c AS (SELECT DISTINCT candidate_id, request_id, semantic_score AS s FROM insertion_candidates WHERE candidate_id IS NOT NULL AND semantic_score IS NOT NULL AND NOT isnan(semantic_score))
SELECT candidate_id, round(s / max(s) OVER (PARTITION BY request_id), 6) AS share, CAST(row_number() OVER (PARTITION BY request_id ORDER BY s DESC, candidate_id) AS INTEGER) AS rank FROM c""")
def candidate_shares(spark, d):
    """Scores as shares of the request's best, and ranks."""
    from strandwork.operators.ordered import rank_within

    c = table(spark, d, "insertion_candidates").where("candidate_id is not null and semantic_score is not null and not isnan(semantic_score)").select("candidate_id", "request_id", F.col("semantic_score").alias("s")).distinct()
    best = c.groupBy("request_id").agg(F.max("s").alias("best")).withColumnRenamed("request_id", "_r")
    c = c.join(best, F.col("request_id").eqNullSafe(F.col("_r"))).drop("_r")
    return rank_within(c, ["request_id"], [F.desc("s"), F.asc("candidate_id")], "rank").select("candidate_id", F.round(F.try_divide("s", "best"), 6).alias("share"), "rank")


# -- documents -----------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_extract(text, '(?m)^#\s+(ADR-[0-9]+):', 1) AS decision, trim(regexp_extract(text, '(?m)^#\s+ADR-[0-9]+:[ \t]*([^\n]+)', 1)) AS title,
CASE WHEN regexp_extract(text, '## Status\s+(\w+)', 1) = '' THEN 'accepted' ELSE lower(regexp_extract(text, '## Status\s+(\w+)', 1)) END AS status FROM documents WHERE regexp_matches(text, '(?m)^#\s+ADR-[0-9]+:')""")
def decision_headers(spark, d):
    return products.decision_headers(table(spark, d, "documents")).drop("domains", "layers")


_DECIDED = "2025-01-13"
_ADR = rf"""a AS (SELECT DISTINCT regexp_extract(text, '(?m)^#\s+(ADR-[0-9]+):', 1) AS decision, unnest(list_filter(string_split_regex(lower(regexp_extract(text, '(?m)^#\s+ADR-[0-9]+:[ \t]*([^\n]+)', 1)), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS domain, created_at FROM documents WHERE regexp_matches(text, '(?m)^#\s+ADR-[0-9]+:')),
pd AS (SELECT DISTINCT file_path, list_filter(string_split_regex(lower(regexp_replace(list_extract(string_split(file_path, '/'), -1), '[.][^.]+$', '')), '[^a-z0-9]+'), lambda x: length(x) > 1) AS ws, updated_at FROM file_hashes),
ch AS (SELECT DISTINCT unnest(ws) AS domain FROM pd WHERE updated_at >= epoch_ms(TIMESTAMP '{_CUT}')), kn AS (SELECT DISTINCT unnest(ws) AS domain FROM pd), cd AS (SELECT DISTINCT decision FROM a WHERE epoch_ms(created_at) >= epoch_ms(TIMESTAMP '{_DECIDED}'))"""


@query(f"""WITH {_ADR} SELECT DISTINCT 'adr_gap' AS kind, decision, domain FROM a WHERE domain IN (SELECT domain FROM ch) AND decision NOT IN (SELECT decision FROM cd) UNION ALL SELECT DISTINCT 'adr_orphaned', decision, domain FROM a WHERE domain NOT IN (SELECT domain FROM kn)""")
def decision_drift(spark, d):
    """Decisions on what has changed since, and on what no file is about; a decision's domains are the words of its title,
    a file's those of its name."""
    docs = table(spark, d, "documents")
    a = cut(products.decision_headers(docs).join(docs.select("doc_id", "created_at"), "doc_id").select("decision", t.tokens("title").alias("domains"), "created_at"))
    h = table(spark, d, "file_hashes").select(F.explode(t.tokens(t.stem("file_path"))).alias("domain"), "updated_at")
    since = F.lit(_CUT).cast("timestamp")
    return products.decision_drift(a, h.where(F.col("updated_at") >= F.unix_millis(since)), h, a.where(F.col("created_at") >= F.lit(_DECIDED).cast("timestamp")))


@query(r"""SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '`([A-Za-z0-9_./-]+[.](?:ts|tsx|js|jsx|py|go|java|rs|rb|cpp|swift))`', 1)) AS path FROM documents WHERE text IS NOT NULL""")
def document_file_references(spark, d):
    return products.referenced_files(table(spark, d, "documents"))


@query(f"""WITH {_HEADS} SELECT doc_id, count(*) AS n_headings, CAST(sum(CASE WHEN starts_with(title, 'Requirement:') THEN 1 ELSE 0 END) AS BIGINT) AS n_requirements, CAST(sum(CASE WHEN starts_with(title, 'Scenario:') THEN 1 ELSE 0 END) AS BIGINT) AS n_scenarios, min(CASE WHEN title = 'Purpose' THEN pos END) IS NOT NULL AS has_purpose
FROM h WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_kind = 'spec') GROUP BY 1""")
def spec_listing(spark, d):
    """Specifications with what they hold."""
    h = extract.headings(table(spark, d, "documents").where("doc_kind = 'spec'"))
    is_ = lambda w: F.sum(F.col("title").startswith(w).cast("int"))
    return h.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_headings"), is_("Requirement:").alias("n_requirements"), is_("Scenario:").alias("n_scenarios"), F.max(F.col("title") == "Purpose").alias("has_purpose"))


@query(r"""WITH x AS (SELECT doc_id, replace(text, chr(13), '') AS text FROM documents WHERE doc_kind = 'spec' AND text IS NOT NULL), y AS (SELECT doc_id, regexp_extract(text, '(?m)^##[ \t]+Purpose[ \t]*\n\s*([^\n]+)', 1) AS p FROM x) SELECT doc_id, trim(p) AS purpose FROM y WHERE p <> ''""")
def spec_purposes(spark, d):
    """The first paragraph of each specification's purpose, which is a line in these texts."""
    s = table(spark, d, "documents").where("doc_kind = 'spec' and text is not null").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    return s.select("doc_id", F.split_part(products.section(F.col("text"), "Purpose"), F.lit("\n"), F.lit(1)).alias("purpose")).where("purpose is not null").withColumn("purpose", F.trim("purpose"))


@query("""WITH k AS (SELECT coalesce(source, 'none') AS source, doc_kind, count(*) AS n, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS n_chars FROM documents GROUP BY 1, 2) SELECT * FROM k""")
def document_groups(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source"), "doc_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("n_chars"))


@query("SELECT tool, CAST(sum(CASE WHEN ms < 5 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS total, CAST(floor(100.0 * sum(CASE WHEN ms < 5 THEN 1 ELSE 0 END) / count(*) + 0.5) AS BIGINT) AS hit_rate FROM (SELECT DISTINCT event_id, tool, ms FROM mcp_events WHERE tool IS NOT NULL AND ms IS NOT NULL AND NOT isnan(ms) AND ms >= 0) m GROUP BY tool")
def events_cache_stats(spark, d):
    """Hits and misses of a cache per tool, a call under five milliseconds being a hit."""
    from strandwork.operators.events import cache_stats

    m = table(spark, d, "mcp_events").where("tool is not null and ms is not null and not isnan(ms) and ms >= 0").select("event_id", "tool", "ms").distinct()
    return cache_stats(m.select(F.col("tool"), (F.col("ms") < 5).alias("hit")), "tool")
