"""Specifications, decisions and reports on them: validation, coverage, verification scores, roles, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.text import alphanumeric, jaccard, split_words, tokens

# The rules of a specification (name, level, pattern, whether the pattern must be there or must not).
RULES = [
    ("purpose_missing", "error", r"(?m)^##[ \t]+Purpose\b", True), ("requirements_missing", "error", r"(?m)^##[ \t]+Requirements\b", True), ("requirement_heading_missing", "warning", r"(?m)^###[ \t]+Requirement:", True),
    ("scenario_missing", "warning", r"(?m)^####[ \t]+Scenario:", True), ("delta_marker", "error", r"(?m)^##[ \t]+(?:ADDED|MODIFIED|REMOVED)\b", False), ("keyword_missing", "warning", r"\b(?:SHALL|MUST|SHOULD|MAY)\b", True),
]


def validate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rule, level): the rules each specification breaks; null texts are left out."""
    broken = [F.when(F.col(text).rlike(p) != need, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"))) for rule, level, p, need in RULES]
    return docs.where(F.col(text).isNotNull()).select(doc_id, F.explode(F.array_compact(F.array(*broken))).alias("b")).select(doc_id, "b.rule", "b.level")


# The first of these that fits names what a then-clause asserts.
CLAUSES = [
    ("status", r"(?i)\b(?:status|returns?)\s+(?:code\s+)?[1-5]\d\d\b"), ("throws", r"(?i)\bthrows?\b|\braises?\b"), ("returns", r"(?i)\breturns?\b"), ("creates", r"(?i)\bcreates?\b"), ("negative", r"(?i)\b(?:does not|must not|never|no longer)\b"),
    ("limit", r"(?i)\bat (?:most|least)\b"),
]


def clause_kind(c: Column) -> Column:
    out = F.lit("other")
    for kind, pattern in reversed(CLAUSES):
        out = F.when(c.rlike(pattern), kind).otherwise(out)
    return out


def scenarios(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, given, when_clause, then_clause, kind): 'Given .. when .. then ..' sentences, kind of the then-clause."""
    s = F.regexp_extract_all(text, F.lit(r"(Given [^.\r\n]*?, when [^.\r\n]*?, then [^.\r\n]*)"), 1)
    d = docs.where(F.col(text).isNotNull()).select(doc_id, F.posexplode(s).alias("pos", "s"))
    part = lambda p: F.trim(F.regexp_extract("s", p, 1))
    return d.select(doc_id, "pos", part(r"^Given (.*?), when ").alias("given"), part(r", when (.*?), then ").alias("when_clause"), part(r", then (.*)$").alias("then_clause")).withColumn("kind", clause_kind(F.col("then_clause")))


def coverage_percent(covered: Column, total: Column, digits: int = 0) -> Column:
    """Percent covered, 0 of nothing being 0, rounded half up."""
    scale = 10**digits
    return F.when(total == 0, 0.0).otherwise(F.floor(100.0 * covered / total * scale + 0.5) / scale)


def requirement_implemented(requirement: Column, code: Column, share: float = 0.5) -> Column:
    """Whether at least so much of a requirement's longer words occur in a text."""
    w = F.array_distinct(F.filter(tokens(requirement), lambda x: F.length(x) > 3))
    return (F.size(w) > 0) & (F.size(F.filter(w, lambda x: F.contains(F.lower(code), x))) >= F.ceil(F.size(w) * F.lit(share)))


def set_match(predicted: Column, actual: Column) -> Column:
    """struct(precision, recall, f1) of two sets of names, case aside; two empty sets agree fully."""
    low = lambda a: F.array_distinct(F.transform(a, lambda x: F.lower(x)))
    p, a = low(predicted), low(actual)
    k = F.size(F.array_intersect(p, a))
    none = (F.size(p) == 0) & (F.size(a) == 0)
    precision = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(k, F.size(p)), F.lit(0.0)))
    recall = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(k, F.size(a)), F.lit(0.0)))
    return F.struct(precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def verification_score(purpose: Column, requirement: Column, imports: Column, exports: Column) -> Column:
    return 0.50 * purpose + 0.35 * requirement + 0.05 * imports + 0.10 * exports


def purpose_similarity(a: Column, b: Column) -> Column:
    """Jaccard share of the five-letter stems of words of four letters or more."""
    stems = lambda x: F.array_distinct(F.transform(F.filter(tokens(x), lambda w: F.length(w) > 3), lambda w: F.substring(w, 1, 5)))
    return jaccard(stems(a), stems(b))


def cluster_role(n_entry: Column, n_hub: Column, n_files: Column) -> Column:
    return (
        F.when(n_entry > n_files * 0.5, "entry_layer").when((n_hub > 0) & (n_entry > 0), "orchestrator").when(n_hub > 0, "core_utilities")
        .when(n_entry > 0, "api_layer").otherwise("internal")
    )


def clusters(nodes: DataFrame) -> DataFrame:
    """(cluster, n_files, n_functions, n_entry, n_hub, role): path segments of the functions with their role."""
    n = nodes.where("is_external = 0").select("id", "file_path", "is_hub", "is_entry_point").distinct()
    c = n.groupBy(F.try_element_at(F.split("file_path", "/"), F.lit(4)).alias("cluster")).agg(
        F.count_distinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_functions"), F.sum((F.col("is_entry_point") == 1).cast("int")).alias("n_entry"), F.sum((F.col("is_hub") == 1).cast("int")).alias("n_hub")
    )
    return c.withColumn("role", cluster_role(F.col("n_entry"), F.col("n_hub"), F.col("n_files")))


def community_report(communities: DataFrame, pairs: DataFrame, degrees: DataFrame) -> DataFrame:
    """(community, label, size, internal_edges, density): communities (id, community), pairs (caller_id, callee_id), degrees
    (id, fan_in); the label is the member that most call."""
    c = communities.select("id", "community")
    inner = (
        pairs.select("caller_id", "callee_id").distinct().join(c.select(F.col("id").alias("caller_id"), F.col("community").alias("a")), "caller_id")
        .join(c.select(F.col("id").alias("callee_id"), F.col("community").alias("b")), "callee_id").where("a = b").groupBy(F.col("a").alias("community")).agg(F.count(F.lit(1)).alias("internal_edges"))
    )
    top = c.join(degrees.select("id", "fan_in"), "id", "left").groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(-F.coalesce("fan_in", F.lit(0)), "id")).alias("m"))
    out = top.join(inner, "community", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    return out.select("community", F.col("m.id").alias("label"), "size", "internal_edges", F.coalesce(F.try_divide(F.col("internal_edges"), F.col("size") * (F.col("size") - 1)), F.lit(0.0)).alias("density"))


#: Decisions that block a commit, and those that are dropped on a purge.
BLOCKING, INACTIVE = ("verified", "approved"), ("rejected", "synced", "phantom")


def patch(store: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """store with the non-null columns of changes (same key) in place of its own."""
    cols = [c for c in store.columns if c != key]
    new = changes.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in cols if c in changes.columns])
    return store.join(new, key, "left").select(*[F.col(key) if c == key else F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in store.columns])


def decision_scope(files: Column, domains: Column, text: Column) -> Column:
    """'cross-domain' for files in two or more two-level folders, or two domains and a contract word that is no refactoring."""
    dirs = F.array_distinct(F.transform(files, lambda f: F.array_join(F.slice(F.split(f, "/"), 1, 2), "/")))
    contract = text.rlike(r"(?i)\b(?:contract|schema|protocol|interface|api)\b") & ~text.rlike(r"(?i)\brefactor")
    return F.when(F.size(dirs) >= 2, "cross-domain").when((F.size(F.array_distinct(domains)) >= 2) & contract, "cross-domain").otherwise("local")


def infer_types(files: DataFrame) -> DataFrame:
    """(file_id, variable, type): types that declarations name, the last of a variable counting."""
    js = F.regexp_extract_all("content", F.lit(r"\b(?:const|let|var)\s+\w+(?:\s*:\s*[A-Z]\w*|\s*=\s*new\s+[A-Z]\w*)"), 0)
    py = F.regexp_extract_all("content", F.lit(r"\b\w+(?:\s*:\s*[A-Z]\w*\s*=|\s*=\s*[A-Z]\w*\()"), 0)
    go = F.regexp_extract_all("content", F.lit(r"\b\w+\s*:=\s*&?[A-Z]\w*\{|\bvar\s+\w+\s+\*?[A-Z]\w*"), 0)
    x = files.where("content is not null").select("file_id", F.posexplode(F.concat(js, py, go)).alias("pos", "d"))
    name = F.regexp_extract("d", r"^(?:(?:const|let|var)\s+)?(\w+)", 1)
    kind = F.regexp_extract("d", r"^(?:(?:const|let|var)\s+)?\w+[^A-Z]*([A-Z]\w*)", 1)
    return x.select("file_id", "pos", name.alias("variable"), kind.alias("type")).where("type <> ''").groupBy("file_id", "variable").agg(F.max_by("type", "pos").alias("type"))


def match_domains(names: DataFrame, domains: DataFrame) -> DataFrame:
    """(name, domain): equal but for case and signs, else the smallest domain that holds the name or lies in it.

    Domains are few and come in by a join on their letters first; the rest meet on a shared word.
    """
    n, d = names.select("name").distinct().withColumn("k", alphanumeric("name")), domains.select("domain").distinct().withColumn("k", alphanumeric("domain"))
    same = n.join(d, "k").groupBy("name").agg(F.min("domain").alias("domain"))
    rest = n.join(same.select("name"), "name", "left_anti").withColumn("w", F.explode(split_words("name")))
    part = rest.join(d.select("domain", F.col("k").alias("dk"), F.explode(split_words("domain")).alias("w")), "w").where(F.col("k").contains(F.col("dk")) | F.col("dk").contains(F.col("k")))
    return same.unionByName(part.groupBy("name").agg(F.min("domain").alias("domain")))
