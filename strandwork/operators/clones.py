"""Copies and near copies of texts: exact, renamed and similar.

The similarity join is exact. A text's shingles are ordered from the rarest up; two texts of a Jaccard similarity of t
share a shingle among the first n - ceil(t * n) + 1 of either (n shingles), so only those go into the join, and every pair
that meets there is compared in full. Copies are one class first, and only one text of a class takes part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.text import normalise_code, rename_identifiers, sha16, shingles, unicode_words, words
from strandwork.util import cut


def _plain(units: DataFrame, unit_id: str, code: str, least_lines: int, least_tokens: int) -> DataFrame:
    u = units.select(F.col(unit_id).alias("uid"), F.col(code).alias("code")).where("code is not null")
    return u.where((F.size(F.split("code", "\n")) >= least_lines)).withColumn("plain", normalise_code("code")).where(F.size(words("plain")) >= least_tokens)


def clone_groups(units: DataFrame, unit_id: str, code: str, least_lines: int = 5, least_tokens: int = 10) -> DataFrame:
    """(unit_id, kind, group_id): units whose code is the same but for comments and white space ('exact'), or but for the
    names as well ('renamed'); a unit in an exact group is in no other. Short units and null code are left out.
    """
    u = _plain(units, unit_id, code, least_lines, least_tokens)
    u = u.withColumn("h1", sha16("plain")).withColumn("h2", sha16(rename_identifiers("plain"))).select("uid", "h1", "h2")
    u = cut(u)
    many = lambda df, h: df.groupBy(h).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(h)
    exact = u.join(many(u, "h1"), "h1", "left_semi").select("uid", F.lit("exact").alias("kind"), F.col("h1").alias("group_id"))
    rest = u.join(many(u, "h1"), "h1", "left_anti")
    renamed = rest.join(many(rest, "h2"), "h2", "left_semi").select("uid", F.lit("renamed").alias("kind"), F.col("h2").alias("group_id"))
    return exact.unionByName(renamed).withColumnRenamed("uid", unit_id)


def near_groups(units: DataFrame, unit_id: str, code: str, grouped: DataFrame, threshold: float = 0.7, least_lines: int = 5, least_tokens: int = 10) -> DataFrame:
    """(unit_id, kind 'near', group_id): units in none of the groups so far (column unit_id) whose runs of five words, names
    renamed, are similar to those of the group's first unit.

    As if one went through the units by id: a unit that is in no group yet takes all later ones that are similar to it and
    in none either. group_id is the hash of the first unit's id. Similar pairs come from the exact join below.
    """
    u = _plain(units, unit_id, code, least_lines, least_tokens).join(grouped.select(F.col(unit_id).alias("uid")), "uid", "left_anti")
    u = cut(u.select("uid", rename_identifiers("plain").alias("plain")))
    pairs, member = similar_classes(u, "uid", "plain", threshold, split=words)
    member = cut(member)
    left = cut(pairs.select("a", "b"))
    led = []
    while not left.isEmpty():
        # nobody before them is undecided, so they lead; whoever is similar to one of them is taken by the first
        first = left.select(F.col("a").alias("id")).distinct().join(left.select(F.col("b").alias("id")), "id", "left_anti")
        new = cut(left.join(first.withColumnRenamed("id", "a"), "a", "left_semi").groupBy("b").agg(F.min("a").alias("leader")))
        led.append(new)
        done = cut(new.select(F.col("b").alias("id")).unionByName(first))
        left = cut(left.join(done.withColumnRenamed("id", "a"), "a", "left_anti").join(done.withColumnRenamed("id", "b"), "b", "left_anti"))
    leads = member.select(F.col("class_id").alias("b"), F.col("class_id").alias("leader")).limit(0)
    for x in led:
        leads = leads.unionByName(x)
    m = member.join(leads.withColumnRenamed("b", "class_id"), "class_id", "left").select(F.col("uid").alias(unit_id), F.coalesce("leader", "class_id").alias("leader"))
    m = cut(m)
    many = m.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("leader")
    return m.join(many, "leader", "left_semi").select(unit_id, F.lit("near").alias("kind"), sha16(F.col("leader").cast("string")).alias("group_id"))


def similar_texts(texts: DataFrame, text_id: str, text: str, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(text_id, class_id, n_links): each text's class of equal shingle sets and how many other classes are similar.

    class_id is the smallest id of the class. Texts of fewer than n words are compared by all their words. Null texts
    are left out.
    """
    pairs, member = similar_classes(texts, text_id, text, threshold, n)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return member.join(ends, "class_id", "left").select(text_id, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similar_classes(texts: DataFrame, text_id: str, text: str, threshold: float = 0.8, n: int = 5, split: Callable[[str], Column] = unicode_words) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b, similarity of classes; members text_id, class_id). split gives a text's words.

    Texts without words are the same only if they are equal, and similar to none.
    """
    t = texts.select(F.col(text_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").withColumn("w", split("text"))
    sh = F.when(F.size("w") >= n, shingles("w", n)).otherwise(F.array_distinct("w"))
    whole = F.when(F.size(sh) > 0, F.array_join(F.array_sort(sh), "\n")).otherwise(F.concat(F.lit("\n"), "text"))
    t = t.select("id", F.transform(F.array_sort(sh), lambda x: F.xxhash64(x)).alias("s"), F.sha2(whole, 256).alias("h"))
    t = cut(t)
    classes = t.groupBy("h").agg(F.min("id").alias("class_id"))
    member = t.select("id", "h").join(classes, "h").select(F.col("id").alias(text_id), "class_id")
    one = cut(t.join(classes, (t["h"] == classes["h"]) & (t["id"] == classes["class_id"])).select("class_id", "s").dropDuplicates(["class_id"]).where(F.size("s") > 0))
    grams = one.select("class_id", F.size("s").alias("size"), F.explode("s").alias("g"))
    rare = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    # the prefix needs each text's shingles from the rarest up
    order = Window.partitionBy("class_id").orderBy("df", "g")
    prefix = grams.join(rare.where("df > 1"), "g").withColumn("i", F.row_number().over(order))
    # shingles that no other text has come first in the order, so they use up places of the prefix
    own = grams.join(rare.where("df = 1"), "g", "left_semi").groupBy("class_id").agg(F.count(F.lit(1)).alias("alone"))
    prefix = prefix.join(own, "class_id", "left").withColumn("place", F.col("i") + F.coalesce("alone", F.lit(0)))
    prefix = cut(prefix.where(F.col("place") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).select("class_id", "size", "g"))
    a, b = prefix.alias("a"), prefix.alias("b")
    meet = a.join(b, F.col("a.g") == F.col("b.g")).where("a.class_id < b.class_id").where(F.least("a.size", "b.size") >= F.lit(threshold) * F.greatest("a.size", "b.size"))
    meet = meet.select(F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b")).distinct()
    both = meet.join(one.select(F.col("class_id").alias("a"), F.col("s").alias("sa")), "a").join(one.select(F.col("class_id").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    pairs = both.withColumn("similarity", inter / (F.size("sa") + F.size("sb") - inter)).where(F.col("similarity") >= threshold - 1e-9).select("a", "b", "similarity")
    return cut(pairs), member
