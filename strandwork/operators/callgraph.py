"""The call graph as tables: lookups, degrees, hubs, leaves, files, classes, layers and statistics.

Every operator takes edges (caller_id, callee_id, caller_file, callee_file, call_type ...) and nodes (id, name, file_path,
class_name, is_external, docstring ...). Parallel and redelivered edges count once unless a docstring says otherwise; null
ids are ignored; only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.text import TEST_PATH
from strandwork.operators.ordered import rank_within
from strandwork.util import js_round

HUB_FAN_IN = 5
GOD_FAN_OUT = 8
LOW_FAN_IN, LOW_FAN_OUT = 2, 3


def call_pairs(edges: DataFrame) -> DataFrame:
    """(caller_id, callee_id) distinct."""
    return edges.select("caller_id", "callee_id").where("caller_id is not null and callee_id is not null").distinct()


def file_of(c: str | Column) -> Column:
    """The file part of an id, null where it has none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.contains("::"), F.split_part(c, F.lit("::"), F.lit(1)))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) over distinct neighbours for every node, 0 without any.

    Both counts come out of one shuffle: each pair gives a caller row and a callee row.
    """
    p = call_pairs(edges)
    ends = p.select(F.explode(F.array(F.struct(F.col("callee_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("caller_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counts = ends.select("e.*").groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("id").distinct().join(counts, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out")])


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with the counted fan_in and fan_out in place of the stored ones."""
    return nodes.drop("fan_in", "fan_out").join(degrees(nodes, edges), "id")


def callees_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges out of a set of ids (column id): one semi-join, not a lookup for each."""
    return edges.join(ids.select(F.col("id").alias("caller_id")).distinct(), "caller_id", "left_semi")


def callers_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges into a set of ids (column id)."""
    return edges.join(ids.select(F.col("id").alias("callee_id")).distinct(), "callee_id", "left_semi")


def edges_of_file(edges: DataFrame, file: str) -> DataFrame:
    """Edges out of and into a file, with direction 'out' or 'in'; one inside the file comes out as both."""
    out = edges.where(F.col("caller_file") == file).withColumn("direction", F.lit("out"))
    return out.unionByName(edges.where(F.col("callee_file") == file).withColumn("direction", F.lit("in")))


def caller_files(edges: DataFrame) -> DataFrame:
    """(callee_file, caller_file) distinct, other files only."""
    return edges.select("callee_file", "caller_file").where("callee_file is not null and caller_file is not null and callee_file <> caller_file").distinct()


def search_names(nodes: DataFrame, text: str, limit: int | None = 50) -> DataFrame:
    """Internal nodes whose name holds the text in any case, by name and id."""
    found = nodes.where((F.col("is_external") == 0) & F.lower("name").contains(text.lower())).select("id", "name", "file_path").distinct().orderBy("name", "id")
    return found.limit(limit) if limit else found


def hubs(nodes: DataFrame, edges: DataFrame, least: int = HUB_FAN_IN) -> DataFrame:
    """(id, name, fan_in, fan_out): internal nodes with at least so many callers."""
    return with_degrees(nodes, edges).where((F.col("is_external") == 0) & (F.col("fan_in") >= least)).select("id", "name", "fan_in", "fan_out")


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, fan_out): internal nodes that are never a callee."""
    return with_degrees(nodes, edges).where("is_external = 0 and fan_in = 0").select("id", "name", "fan_out")


def leaf_functions(nodes: DataFrame, edges: DataFrame, test_path: str = r"(?i)(?:^|/)(?:tests?|__tests__)/|\.(?:test|spec)\.") -> DataFrame:
    """(id, name, file_path, fan_in): internal nodes outside test files that call nothing."""
    return with_degrees(nodes, edges).where((F.col("is_external") == 0) & (F.col("fan_out") == 0) & ~F.coalesce(F.col("file_path").rlike(test_path), F.lit(False))).select("id", "name", "file_path", "fan_in")


def low_risk_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, fan_in, fan_out): called by few, calling few, neither hub nor entry point."""
    d = with_degrees(nodes, edges)
    return d.where(f"is_external = 0 and fan_in between 1 and {LOW_FAN_IN} and fan_out <= {LOW_FAN_OUT}").select("id", "name", "fan_in", "fan_out")


def critical_hubs(nodes: DataFrame, edges: DataFrame, violations: DataFrame | None = None, least: int = HUB_FAN_IN) -> DataFrame:
    """(id, fan_in, fan_out, criticality, stability, approach).

    criticality is 3 per caller, 1.5 per callee and 10 for a file in a layer violation; stability is what is left of 100.
    """
    d = with_degrees(nodes, edges).where(f"is_external = 0 and fan_in >= {least}")
    if violations is None:
        d = d.withColumn("bad", F.lit(0))
    else:
        files = violations.select(F.explode(F.array("caller_file", "callee_file")).alias("file_path")).distinct().withColumn("bad", F.lit(1))
        d = d.join(files, "file_path", "left")
    score = 3.0 * F.col("fan_in") + 1.5 * F.col("fan_out") + 10.0 * F.coalesce("bad", F.lit(0))
    stability = F.greatest(F.lit(0), js_round(F.lit(100) - F.least(F.lit(100.0), F.col("criticality"))))
    approach = F.when(F.col("stability") < 30, "extract interface first").when(F.col("stability") < 60, "split responsibilities").otherwise("refactor directly")
    return d.withColumn("criticality", score).withColumn("stability", stability.cast("int")).withColumn("approach", approach).select("id", "fan_in", "fan_out", "criticality", "stability", "approach")


def god_functions(nodes: DataFrame, edges: DataFrame, least: int = GOD_FAN_OUT) -> DataFrame:
    """(id, name, fan_out): internal nodes that call at least so many others."""
    return with_degrees(nodes, edges).where((F.col("is_external") == 0) & (F.col("fan_out") >= least)).select("id", "name", "fan_out")


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_hubs, n_entry_points, avg_fan_in, avg_fan_out, density over internal nodes."""
    d = with_degrees(nodes, edges).where("is_external = 0")
    n = F.count(F.lit(1))
    return d.agg(
        n.alias("n_nodes"), F.sum("fan_out").alias("n_edges"), F.sum((F.col("fan_in") >= HUB_FAN_IN).cast("int")).alias("n_hubs"),
        F.sum((F.col("fan_in") == 0).cast("int")).alias("n_entry_points"), F.round(F.avg("fan_in"), 6).alias("avg_fan_in"), F.round(F.avg("fan_out"), 6).alias("avg_fan_out"),
        F.round(F.try_divide(F.sum("fan_out"), n * (n - 1)), 9).alias("density"),
    )


def external_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, n_callers): callees that no node has, made up as external ones."""
    missing = call_pairs(edges).withColumnRenamed("callee_id", "id").join(nodes.select("id"), "id", "left_anti")
    return missing.groupBy("id").agg(F.count(F.lit(1)).alias("n_callers")).select("id", F.element_at(F.split("id", "::"), -1).alias("name"), "n_callers")


def class_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, class_name, is_module, n_methods, fan_in, fan_out): functions by class, or by file where they have none."""
    d = with_degrees(nodes, edges).where("is_external = 0")
    own = F.coalesce("class_name", F.element_at(F.split("file_path", "/"), -1))
    return d.groupBy("file_path", own.alias("class_name"), F.col("class_name").isNull().alias("is_module")).agg(
        F.count(F.lit(1)).alias("n_methods"), F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out")
    )


# -- files ---------------------------------------------------------------------------------------------------------


def file_edges(edges: DataFrame) -> DataFrame:
    """(source, target, n_calls): calls between different files, each distinct pair of functions once."""
    p = edges.select("caller_id", "callee_id", F.col("caller_file").alias("source"), F.col("callee_file").alias("target")).where("source is not null and target is not null and source <> target").distinct()
    return p.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n_calls"))


def file_degrees(links: DataFrame) -> DataFrame:
    """(file, in_degree, out_degree) over distinct neighbours of links (source, target)."""
    e = links.select("source", "target").distinct()
    ends = e.select(F.col("target").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("source").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("file").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def directory_clusters(links: DataFrame) -> DataFrame:
    """(directory, n_files, internal_edges, external_edges, cohesion, coupling) of directories with two files or more.

    cohesion is the share of possible inner links that exist, coupling the share of a cluster's links that leave it.
    """
    d = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    e = links.select("source", "target").distinct()
    files = e.select(F.col("source").alias("f")).unionByName(e.select(F.col("target").alias("f"))).distinct()
    size = files.groupBy(d("f").alias("directory")).agg(F.count(F.lit(1)).alias("n_files")).where("n_files >= 2")
    sides = e.select(d("source").alias("s"), d("target").alias("t"))
    inner = (F.col("s") == F.col("t")).cast("int")
    both = sides.select(F.explode(F.array_distinct(F.array("s", "t"))).alias("directory"), inner.alias("inner"))
    count = both.groupBy("directory").agg(F.sum("inner").alias("internal_edges"), F.sum(1 - F.col("inner")).alias("external_edges"))
    i, x, n = F.coalesce("internal_edges", F.lit(0)), F.coalesce("external_edges", F.lit(0)), F.col("n_files")
    return size.join(count, "directory", "left").select(
        "directory", "n_files", i.alias("internal_edges"), x.alias("external_edges"),
        F.round(i / (n * (n - 1)), 6).alias("cohesion"), F.round(F.coalesce(F.try_divide(x, i + x), F.lit(0.0)), 6).alias("coupling"),
    )


def cross_domain_dependencies(links: DataFrame, depth: int = 4) -> DataFrame:
    """(domain, depends_on, n_links): links between domains, a domain being the path segment at depth."""
    dom = lambda c: F.try_element_at(F.split(c, "/"), F.lit(depth))
    return links.select(dom("source").alias("domain"), dom("target").alias("depends_on")).where("domain <> depends_on").groupBy("domain", "depends_on").agg(F.count(F.lit(1)).alias("n_links"))


#: Layers from the top down, by path segment.
LAYERS = {"cli": 0, "api": 0, "render": 1, "worker": 1, "core": 2, "analyzer": 2, "index": 2, "store": 3, "util": 4}


def layer_violations(edges: DataFrame, layers: dict[str, int] = LAYERS) -> DataFrame:
    """(caller_id, callee_id, caller_file, callee_file, caller_layer, callee_layer): calls from a lower to a higher layer."""
    seg = F.array(*[F.lit(x) for x in layers])
    rank = F.create_map(*[F.lit(x) for kv in layers.items() for x in kv])
    layer = lambda c: F.try_element_at(F.array_intersect(F.split(c, "/"), seg), F.lit(1))
    e = edges.select("caller_id", "callee_id", "caller_file", "callee_file").distinct()
    e = e.withColumn("caller_layer", layer("caller_file")).withColumn("callee_layer", layer("callee_file"))
    return e.where(rank[F.col("caller_layer")] > rank[F.col("callee_layer")])


def node_rankings(links: DataFrame) -> DataFrame:
    """(file, in_degree, out_degree, kind, rank): files by in_degree within leaf, root and inner ones."""
    d = file_degrees(links)
    kind = F.when(F.col("out_degree") == 0, "leaf").when(F.col("in_degree") == 0, "root").otherwise("inner")
    return rank_within(d.withColumn("kind", kind), ["kind"], [F.desc("in_degree"), F.asc("file")], "rank")


def one_edge_each(edges: DataFrame) -> DataFrame:
    """Redelivered edges once; of rows that share an edge_id the one loaded last. Edges without an id are left out."""
    cols = [c for c in ("caller_id", "callee_id", "caller_file", "callee_file", "kind", "call_type") if c in edges.columns]
    return edges.where("edge_id is not null").groupBy("edge_id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", *cols)).alias("r")).select("edge_id", "r.*")


def tested_by(edges: DataFrame, nodes: DataFrame, imported: DataFrame | None = None, test_path: str = TEST_PATH) -> DataFrame:
    """(callee_id, test_file, confidence): internal functions called from test files ('called'), or only imported by them
    ('import'; imported being (test_file, target_path, name)), each file once."""
    inner = nodes.where("is_external = 0").where(~F.coalesce(F.col("file_path").rlike(test_path), F.lit(False)))
    e = edges.where(F.col("caller_file").rlike(test_path))
    out = e.join(inner.select(F.col("id").alias("callee_id")), "callee_id", "left_semi").select("callee_id", F.col("caller_file").alias("test_file"), F.lit("called").alias("confidence")).distinct()
    if imported is None:
        return out
    i = imported.where(F.col("test_file").rlike(test_path)).select("test_file", F.col("target_path").alias("file_path"), "name").distinct()
    only = i.join(inner.select(F.col("id").alias("callee_id"), "file_path", "name").distinct(), ["file_path", "name"]).select("callee_id", "test_file").distinct()
    only = only.join(out.select("callee_id", "test_file"), ["callee_id", "test_file"], "left_anti")
    return out.unionByName(only.withColumn("confidence", F.lit("import")))
