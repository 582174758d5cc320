"""HTTP calls matched with routes, and unified search over code and specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.text import normalise_url
from strandwork.operators.retrieval import STRATEGY, composite, role

# Prefixes that a call's path may have before a route's.
PREFIXES = ("/api/v1", "/api/v2", "/api/v3", "/api", "/v1", "/v2", "/v3")


def http_edges(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, route_id, confidence): calls (call_id, method, url) with routes (route_id, method, path).

    'exact': same path and method; 'path': same path without a common prefix or with a method that is not known; 'fuzzy':
    same number of segments, equal but for parameters. A call keeps the best of each route. Fuzzy pairs meet on the number
    of segments and the first segment that is no parameter on either side.
    """
    c = calls.select("call_id", F.upper("method").alias("m1"), normalise_url("url").alias("p"))
    r = routes.select("route_id", F.upper("method").alias("m2"), normalise_url("path").alias("q"))
    strip = F.filter(F.transform(F.array(*map(F.lit, PREFIXES)), lambda x: F.when(F.col("p").startswith(F.concat(x, F.lit("/"))), F.substring(F.col("p"), F.length(x) + 1, F.length("p")))), lambda x: x.isNotNull())
    cand = c.select("call_id", "m1", "p", F.explode(F.array_distinct(F.concat(F.array("p"), strip))).alias("q"))
    known = (F.col("m1") == F.col("m2")) | F.col("m1").isNull() | F.col("m2").isNull() | (F.col("m2") == "UNKNOWN")
    same = cand.join(r, "q").where(known)
    exact = same.select("call_id", "route_id", F.when((F.col("p") == F.col("q")) & (F.col("m1") == F.col("m2")), 0).otherwise(1).alias("o"))
    seg = lambda x: F.split(x, "/")
    left = c.join(exact, "call_id", "left_anti").withColumn("n", F.size(seg("p")))
    right = r.withColumn("n", F.size(seg("q")))
    wild = lambda x: x == ":param"
    fit = F.forall(F.zip_with(seg("p"), seg("q"), lambda a, b: (a == b) | wild(a) | wild(b)), lambda x: x)
    meets = left.withColumn("s", F.explode(F.array_distinct(seg("p")))).where("s not in ('', ':param')")
    rights = right.withColumn("s", F.explode(F.array_distinct(seg("q")))).where("s not in ('', ':param')")
    fuzzy = meets.join(rights, ["n", "s"]).where(known & fit).select("call_id", "route_id", F.lit(2).alias("o"))
    best = exact.unionByName(fuzzy).groupBy("call_id", "route_id").agg(F.min("o").alias("o"))
    return best.select("call_id", "route_id", F.element_at(F.array(F.lit("exact"), F.lit("path"), F.lit("fuzzy")), F.col("o") + 1).alias("confidence"))


def hit_links(code: DataFrame, specs: DataFrame, code_words: DataFrame, spec_words: DataFrame, least: int = 2) -> DataFrame:
    """(function_id, spec_id): code and specification hits of one query that have at least ``least`` words in common.

    code and specs are rankings (query_id, id), code_words and spec_words (id, w). Only hits are compared, never all texts
    that share a word.
    """
    own = lambda hits, words, out: hits.select("query_id", "id").join(words.join(hits.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.collect_set("w").alias("w")), "id").select("query_id", F.col("id").alias(out), "w")
    a, b = own(code, code_words, "function_id"), own(specs, spec_words, "spec_id").withColumnRenamed("w", "w2")
    return a.join(b, "query_id").where(F.size(F.array_intersect("w", "w2")) >= least).select("function_id", "spec_id").distinct()


def unified_search(code: DataFrame, specs: DataFrame, links: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, kind, score, rank): code and specification hits in one list, boosted where they are linked.

    code and specs are rankings (query_id, id, score); links (function_id, spec_id). A hit's score is the share of its
    list's best; a hit with links in the other list gets 0.3 and 0.1 for each link after the first, at most 0.3 more, and
    its kind is 'both'.
    """
    share = lambda df: df.withColumn("share", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    a, b = share(code).select("query_id", F.col("id").cast("string").alias("id"), "share"), share(specs).select("query_id", F.col("id").cast("string").alias("id"), "share")
    l = links.select(F.col("function_id").cast("string").alias("f"), F.col("spec_id").cast("string").alias("s")).distinct()  # noqa: E741
    seen = a.select("query_id", F.col("id").alias("f")).join(l, "f").join(b.select("query_id", F.col("id").alias("s")), ["query_id", "s"])
    n = seen.groupBy("query_id", F.col("f").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("code"))
    m = seen.groupBy("query_id", F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("spec"))
    both = a.withColumn("kind", F.lit("code")).unionByName(b.withColumn("kind", F.lit("spec"))).join(n.unionByName(m), ["query_id", "id", "kind"], "left")
    boost = F.when(F.col("n").isNull(), 0.0).otherwise(0.3 + F.least((F.col("n") - 1) * 0.1, F.lit(0.3)))
    scored = both.select("query_id", "id", F.when(F.col("n").isNotNull(), "both").otherwise(F.col("kind")).alias("kind"), F.round(F.col("share") + boost, 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "kind", "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def orient(hits: DataFrame, edges: DataFrame, nodes: DataFrame, specs: DataFrame, neighbours: int = 5) -> DataFrame:
    """(query_id, section, id, detail, rank): what to look at for a task.

    hits (query_id, id, score, rank) and specs (query_id, id, rank) are rankings. Sections: 'function' the hits, 'file' and
    'domain' (the path's fourth segment) their files and domains by best rank, 'insertion' the ``neighbours`` hits that suit
    an addition best, by score and role (detail is the strategy), 'caller' and 'callee' up to ``neighbours`` of each hit by
    id (detail is the hit), 'spec' the specification hits. The neighbours of all hits come from one semi-join.
    """
    n = nodes.groupBy("id").agg(
        F.min("file_path").alias("file_path"), F.min("signature").alias("signature"), F.min("fan_in").alias("fan_in"), F.min("fan_out").alias("fan_out"), F.max("is_hub").alias("hub"), F.max("is_entry_point").alias("entry")
    )
    h = hits.select("query_id", "id", "score", "rank").join(n, "id", "left")
    of_role = role(F.col("fan_in"), F.col("fan_out"), F.col("hub") == 1, F.col("entry") == 1)
    best = h.groupBy("query_id").agg(F.max("score").alias("most"))
    places = h.join(best, "query_id").withColumn("role", of_role).withColumn("fit", F.round(composite(F.coalesce(F.try_divide("score", "most"), F.lit(0.0)), F.col("role")), 6))
    places = places.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fit"), "id"))).where(F.col("rank") <= neighbours)
    strategy = F.create_map(*[F.lit(x) for kv in STRATEGY.items() for x in kv])[F.col("role")]
    functions = h.select("query_id", F.lit("function").alias("section"), "id", F.col("signature").alias("detail"), "rank")
    w = Window.partitionBy("query_id").orderBy("best", "id")
    files = h.groupBy("query_id", F.col("file_path").alias("id")).agg(F.min("rank").alias("best")).withColumn("rank", F.row_number().over(w))
    parts = [functions, files.select("query_id", F.lit("file").alias("section"), "id", F.lit(None).cast("string").alias("detail"), "rank")]
    domain = h.groupBy("query_id", F.try_element_at(F.split("file_path", "/"), F.lit(4)).alias("id")).agg(F.min("rank").alias("best")).where("id is not null").withColumn("rank", F.row_number().over(w))
    parts.append(domain.select("query_id", F.lit("domain").alias("section"), "id", F.lit(None).cast("string").alias("detail"), "rank"))
    parts.append(places.select("query_id", F.lit("insertion").alias("section"), "id", strategy.alias("detail"), "rank"))
    ids = hits.select("id").distinct()
    for section, own, other in (("caller", "callee_id", "caller_id"), ("callee", "caller_id", "callee_id")):
        near = edges.join(ids.withColumnRenamed("id", own), own, "left_semi").select(F.col(own).alias("hit"), F.col(other).alias("id")).where("id is not null").distinct()
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("hit").orderBy("id"))).where(F.col("rank") <= neighbours)
        parts.append(hits.select("query_id", F.col("id").alias("hit")).join(near, "hit").select("query_id", F.lit(section).alias("section"), "id", F.col("hit").alias("detail"), "rank"))
    parts.append(specs.select("query_id", F.lit("spec").alias("section"), F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("detail"), "rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
