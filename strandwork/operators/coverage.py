"""Change, drift and coverage: changed files against mappings, overlaps of ranges, risk of changes, significance of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.text import base_name, directory
from strandwork.util import cut, js_round

# Names of files that matter to specifications.
HIGH_VALUE = r"(?i)(?:service|controller|handler|middleware|model|schema|entity|repository|route|api|auth|database)"


def severity(kind: Column, n_changes: Column, path: Column, status: Column) -> Column:
    high = base_name(path).rlike(HIGH_VALUE)
    return (
        F.when(kind == "gap", F.when((n_changes > 30) & high, "error").when(n_changes > 5, "warning").otherwise("info"))
        .when(kind == "stale", F.when(status == "deleted", "error").otherwise("warning"))
        .when(kind == "uncovered", F.when(high, "warning").otherwise("info")).when(kind == "orphaned", "warning").otherwise("info")
    )


def drift(changes: DataFrame, mapping: DataFrame, existing: DataFrame, spec_domains: DataFrame) -> DataFrame:
    """(kind, domain, path, severity): where specifications and code have come apart.

    changes (path, status, old_path, n_changes), mapping (domain, path) of declared files, existing (path), spec_domains
    (domain) whose specification changed as well. gap: a changed file whose domain's specification did not; stale: a
    declared file that was deleted or renamed; uncovered: an added file of no domain; orphaned: a declared file that
    does not exist. Each case once.
    """
    m = mapping.select("domain", "path").distinct()
    c = changes.select("path", "status", "old_path", "n_changes").distinct()
    none = F.lit(None).cast("string")
    gap = c.where("status in ('modified', 'added')").join(m, "path").join(spec_domains.select("domain"), "domain", "left_anti").withColumn("kind", F.lit("gap"))
    gone = c.where("status in ('deleted', 'renamed')").select(F.explode(F.array_distinct(F.array(F.col("path"), F.coalesce("old_path", "path")))).alias("path"), "status", "n_changes")
    stale = gone.join(m, "path").withColumn("kind", F.lit("stale"))
    uncovered = c.where("status = 'added'").join(m.select("path"), "path", "left_anti").withColumn("domain", none).withColumn("kind", F.lit("uncovered"))
    orphaned = m.join(existing.select("path"), "path", "left_anti").withColumn("kind", F.lit("orphaned")).withColumn("status", none).withColumn("n_changes", F.lit(0))
    keep = ["kind", "domain", "path", "status", "n_changes"]
    every = gap.select(*keep).unionByName(stale.select(*keep)).unionByName(uncovered.select(*keep)).unionByName(orphaned.select(*keep))
    return every.withColumn("severity", severity(F.col("kind"), F.col("n_changes"), F.col("path"), F.col("status"))).select("kind", "domain", "path", "severity").distinct()


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key: the new one where there is one, of several the one with the greatest version."""
    rest = [c for c in old.columns if c not in key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    # the greatest of structs combines on the map side, whatever a key's share of the rows
    best = both.groupBy(*key).agg(F.max(F.struct("_new", version, *[c for c in rest if c != version])).alias("_b"))
    return best.select(*key, *[F.col("_b")[c].alias(c) for c in rest]).select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def overlaps(points: DataFrame, spans: DataFrame, key: str, start: str, end: str, s: str, e: str, bin_size: int = 512) -> DataFrame:
    """points x spans of the same key whose ranges [start, end] and [s, e] touch, with overlap.

    Both sides are dealt into bins of the range, so that a key with very many rows on either side meets only within a bin;
    a pair counts in the first bin that both share.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.col(b) / bin_size)))
    p = points.where(f"{key} is not null and {start} <= {end}").withColumn("_bin", bins(start, end))
    q = spans.where(f"{key} is not null and {s} <= {e}").withColumn("_bin", bins(s, e))
    both = p.join(q, [key, "_bin"]).where((F.col(start) <= F.col(e)) & (F.col(end) >= F.col(s)))
    both = both.where(F.col("_bin") == F.greatest(F.floor(F.col(start) / bin_size), F.floor(F.col(s) / bin_size)))
    return both.withColumn("overlap", F.least(F.col(end), F.col(e)) - F.greatest(F.col(start), F.col(s)) + 1).drop("_bin")


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, s: str, e: str, name: str, row: str) -> DataFrame:
    """(row, name): for each point the innermost span [s, e) that holds it; the smallest name of several."""
    hit = overlaps(points.withColumn("_at", F.col(at)).withColumn("_end", F.col(at)), spans.withColumn("_e", F.col(e) - 1), key, "_at", "_end", s, "_e")
    return hit.groupBy(row).agg(F.min(F.struct((F.col(e) - F.col(s)).alias("w"), F.col(name).alias("name"))).alias("m")).select(row, F.col("m.name").alias(name))


def change_risk(functions: DataFrame) -> DataFrame:
    """functions with risk: (changed, length, kind, fan_in, test_weight, transitive, boundary).

    The changed share of a function, by length and in absolute lines, weighted by the kind of change, times what few tests
    leave open, times what depends on the function.
    """
    rel, absolute = F.col("changed") / F.greatest(F.col("length"), F.lit(1)), F.log(1 + F.col("changed")) / F.log(F.lit(201.0))
    weight = F.when(F.col("kind") == "signature", 1.5).when(F.col("kind") == "config", 0.4).otherwise(1.0)
    change = F.least(F.least(0.6 * rel + 0.4 * absolute, F.lit(1.0)) * weight, F.lit(1.0))
    cover = 1 / (1 + F.log(1 + F.col("test_weight")))
    risk = change * (1 + cover) * (0.8 * F.log(1 + F.col("fan_in")) + F.least("transitive", F.lit(10.0)) + F.least("boundary", F.lit(1.0)))
    return functions.withColumn("risk", js_round(risk * 100) / 100)


# How much a kind of call carries a change on to the caller.
CALL_WEIGHTS = {"awaited": 1.0, "await": 1.0, "direct": 0.7, "method": 0.6, "callback": 0.4}
OTHER_CALL, MOST_TRANSITIVE = 0.5, 10.0


def transitive_scores(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, transitive): for each seed (column id) the sum over its callers, of any depth d, of w / d^2, at most 10.

    w is the greatest weight of a call by which a caller is first reached. A seed that has its 10 is searched no further,
    so hubs stop after a level or two; the others end with their callers.
    """
    weights = F.create_map(*[F.lit(x) for kv in CALL_WEIGHTS.items() for x in kv])
    e = edges.where("caller_id is not null and callee_id is not null and (kind is null or kind = 'calls')").groupBy("callee_id", "caller_id").agg(F.max(F.coalesce(weights[F.col("call_type")], F.lit(OTHER_CALL))).alias("w"))
    e = cut(e)
    front = cut(seeds.select(F.col("id").alias("seed"), "id").where("id is not null").distinct())
    seen = front.limit(0)
    score, depth = front.select("seed", F.lit(0.0).alias("s")).limit(0), 0
    while not front.isEmpty():
        depth += 1
        step = e.join(front.withColumnRenamed("id", "callee_id"), "callee_id").groupBy("seed", F.col("caller_id").alias("id")).agg(F.max("w").alias("w"))
        new = cut(step.join(seen, ["seed", "id"], "left_anti"))
        score = cut(score.unionByName(new.groupBy("seed").agg((F.sum("w") / F.lit(float(depth * depth))).alias("s"))).groupBy("seed").agg(F.sum("s").alias("s")))
        full = score.where(F.col("s") >= MOST_TRANSITIVE).select("seed")
        seen = cut(seen.unionByName(new.select("seed", "id")).join(full, "seed", "left_anti"))
        front = cut(new.select("seed", "id").join(full, "seed", "left_anti"))
    return score.select(F.col("seed").alias("id"), F.least(F.col("s"), F.lit(MOST_TRANSITIVE)).alias("transitive"))


def boundary_scores(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, boundary): calls of external nodes, three points for the network and databases and one for others, of at most 3."""
    x = nodes.where("is_external = 1").groupBy(F.col("id").alias("callee_id")).agg(F.max(F.when(F.col("external_kind").isin("http", "database"), 3).otherwise(1)).alias("p"))
    e = edges.where("caller_id is not null and (kind is null or kind = 'calls')").select(F.col("caller_id").alias("id"), "callee_id")
    return e.join(x, "callee_id").groupBy("id").agg(F.least(F.sum("p") / 3.0, F.lit(1.0)).alias("boundary"))


def test_weights(tested_by: DataFrame) -> DataFrame:
    """(id, test_weight): 1 for each test file that calls a function, 0.3 for one that only imports it."""
    t = tested_by.groupBy("callee_id", "test_file").agg(F.max(F.when(F.col("confidence") == "called", 1.0).otherwise(0.3)).alias("w"))
    return t.groupBy(F.col("callee_id").alias("id")).agg(F.sum("w").alias("test_weight"))


# What a file's name is worth.
NAME_POINTS = {
    "schema": 25, "model": 25, "entity": 25, "types": 25, "interfaces": 25, "auth": 25, "authentication": 25, "authorization": 25, "api": 25, "routes": 25, "endpoints": 25, "controller": 25, "controllers": 25,
    "database": 25, "db": 25, "repository": 25, "store": 25, "config": 20, "configuration": 20, "settings": 20, "middleware": 20, "interceptor": 20, "guard": 20, "service": 15, "provider": 15, "manager": 15,
    "utils": 5, "util": 5, "helpers": 5, "helper": 5, "common": 5,
}
NAME_LOSSES = {
    "test": -10, "spec": -10, "mock": -10, "stub": -10, "fake": -10, "fixture": -10, "fixtures": -10, "snapshot": -10, "snapshots": -10, "example": -5, "examples": -5, "sample": -5, "samples": -5, "demo": -5,
    "backup": -15, "old": -15, "deprecated": -15, "legacy": -15,
}


def name_score(path: Column) -> Column:
    """Best positive word in the file's name plus all negative ones, within 0 and 30."""
    n = F.lower(base_name(path))
    best = F.greatest(F.lit(0), *[F.when(n.contains(k), v).otherwise(0) for k, v in NAME_POINTS.items()])
    loss = sum((F.when(n.contains(k), v).otherwise(0) for k, v in NAME_LOSSES.items()), F.lit(0))
    return F.least(F.lit(30), F.greatest(F.lit(0), best + loss))


def structure_score(content: Column) -> Column:
    """Points for classes, interfaces, exports, decorators, imports and a middling length, within 0 and 25."""
    n = F.size(F.split(content, "\n"))
    score = (
        F.when(content.rlike(r"\bclass\s+\w+"), 10).otherwise(0) + F.when(content.rlike(r"\b(?:interface|type)\s+\w+\s*[={<]"), 15).otherwise(0)
        + F.when(content.rlike(r"\bexport\s+(?:default\s+)?(?:class|function|const|let|var|interface|type|enum)"), 5).otherwise(0) + F.when(content.rlike(r"@\w+\s*\("), 15).otherwise(0)
        + F.when(F.regexp_count(content, F.lit(r"\bimport\s+.*from\s+['\"][^'\"]+['\"]")) > 10, 10).otherwise(0) + F.when(n.between(50, 500), 5).when(n > 1000, -5).otherwise(0)
    )
    return F.least(F.lit(25), F.greatest(F.lit(0), score))


def connectivity_score(n_in: Column, n_out: Column) -> Column:
    s = F.when(n_in >= 5, 20).when(n_in >= 2, 10).otherwise(0) + F.when(n_out >= 5, 10).otherwise(0) + F.when((n_in == 0) & (n_out == 0), -10).otherwise(0)
    return F.least(F.lit(20), F.greatest(F.lit(0), s))


# What a file's place is worth.
PATH_POINTS = {
    "src/": 10, "lib/": 10, "core/": 15, "domain/": 15, "models/": 15, "api/": 15, "routes/": 15, "controllers/": 15, "config/": 10, "configs/": 10, "services/": 10, "schemas/": 15,
}


def path_score(path: Column) -> Column:
    """The best of the folders a path runs through, or 15 at the root; less for deep places; within 0 and 25."""
    depth = F.size(F.split(path, "/")) - 1
    inside = lambda k: path.startswith(k) | path.contains("/" + k)
    best = F.greatest(F.when(depth == 0, 15).otherwise(0), *[F.when(inside(k), v).otherwise(0) for k, v in PATH_POINTS.items()])
    helper = F.lower(path).contains("utils/") | F.lower(path).contains("helpers/")
    score = best - F.when(depth > 5, 10).otherwise(0) - F.when(helper & (depth > 3), 5).otherwise(0)
    return F.least(F.lit(25), F.greatest(F.lit(0), score))


def tags(path: Column, name_points: Column, connectivity: Column) -> Column:
    """What a file is, as an array: its flags, kinds of name and high scores."""
    from strandwork.functions.text import path_flags

    n, f = F.lower(base_name(path)), path_flags(path)
    has = lambda *words: n.rlike("|".join(words))
    each = [
        ("entry-point", f["is_entry_point"]), ("config", f["is_config"]), ("test", f["is_test"]), ("generated", f["is_generated"]), ("schema", has("schema", "model", "entity")), ("api", has("api", "route", "controller")),
        ("service", has("service", "provider")), ("high-value-name", name_points >= 20), ("high-connectivity", connectivity >= 15),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in each]))


def significance(files: DataFrame, degrees: DataFrame) -> DataFrame:
    """(file_id, name_score, path_score, structure_score, connectivity_score, score, tags) of files, degrees being (file,
    in_degree, out_degree); a file in no link counts as having none."""
    f = files.select("file_id", "file_path", "content").join(degrees.select(F.col("file").alias("file_path"), "in_degree", "out_degree"), "file_path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    f = f.withColumn("c", connectivity_score(zero(F.col("in_degree")), zero(F.col("out_degree")))).withColumn("n", name_score(F.col("file_path")))
    f = f.withColumn("p", path_score(F.col("file_path"))).withColumn("s", zero(structure_score(F.col("content"))))
    total = F.least(F.lit(100), F.greatest(F.lit(0), F.col("n") + F.col("p") + F.col("s") + F.col("c")))
    return f.select(
        "file_id", F.col("n").alias("name_score"), F.col("p").alias("path_score"), F.col("s").alias("structure_score"), F.col("c").alias("connectivity_score"), total.alias("score"),
        tags(F.col("file_path"), F.col("n"), F.col("c")).alias("tags"),
    )


def requirement_links(requirements: DataFrame, functions: DataFrame, least: float = 0.7) -> DataFrame:
    """(req, id, similarity): requirements and functions that share at least so much of their words, the two best each.

    The words of a name are its parts, ordered from the rarest up: two sets of a Jaccard share of t have a word in common
    among the first n - ceil(t * n) + 1 of either (n words), so only those meet, and common words bring nobody together.
    requirements (req, words), functions (id, words).
    """
    r = requirements.select("req", F.array_distinct("words").alias("rw")).where(F.size("rw") > 0)
    f = functions.select("id", F.array_distinct("words").alias("fw")).where(F.size("fw") > 0)
    spread = lambda df, key, words: df.select(key, F.size(words).alias("n"), F.explode(words).alias("w"))
    a, b = spread(r, "req", "rw"), spread(f, "id", "fw")
    often = a.select("w").unionByName(b.select("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k"))

    def first(df: DataFrame, key: str) -> DataFrame:
        i = F.row_number().over(Window.partitionBy(key).orderBy("k", "w"))
        return df.join(often, "w").withColumn("i", i).where(F.col("i") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select(key, "w")

    meet = first(a, "req").join(first(b, "id"), "w").select("req", "id").distinct().join(r, "req").join(f, "id")
    k = F.size(F.array_intersect("rw", "fw"))
    j = meet.select("req", "id", F.round(k / (F.size("rw") + F.size("fw") - k), 6).alias("similarity")).where(F.col("similarity") >= least)
    w = Window.partitionBy("req").orderBy(F.desc("similarity"), "id")
    return j.withColumn("i", F.row_number().over(w)).where("i <= 2").select("req", "id", "similarity")


def directory_stats(files: DataFrame) -> DataFrame:
    """(directory, n_files, n_languages, n_chars)."""
    from strandwork.functions.text import language_of

    return files.groupBy(directory("file_path").alias("directory")).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_distinct(language_of("file_path")).alias("n_languages"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("n_chars")
    )
