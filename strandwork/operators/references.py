"""References to records that do not exist.

Method: parent keys and child keys of every reference go into one long form (parent table, key, tag) and are grouped by
table and key. A group without a parent flag is an orphan key; one whose children's times reach before the parent's
arrival or past its removal holds late or deleted references. Only groups with such a case go back to the rows.

Grouping combines on the map side, so a key with a third of all references reaches its reducer as one partial row per
task. Going back to the rows, the keys that draw more than a fixed share of them, of which there can only be a bounded
number, are broadcast, and the other rows meet their key by an ordinary join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.util import cut

#: A key with more than this share of all references is hot: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 2000


@dataclass(frozen=True)
class Reference:
    """field of the child table refers to key of the parent table, which came at born and went at gone."""

    field: str
    parent: str
    key: str
    born: str
    gone: str


GRAPH_REFERENCES = (
    Reference("caller_id", "nodes", "id", "indexed_at", "deleted_at"),
    Reference("callee_id", "nodes", "id", "indexed_at", "deleted_at"),
    Reference("callee_file", "file_hashes", "file_path", "first_seen_at", "removed_at"),
)


def broken_references(
    child: DataFrame, parents: dict[str, DataFrame], refs: tuple[Reference, ...] = GRAPH_REFERENCES, row_id: str = "edge_id", at: str = "observed_at"
) -> DataFrame:
    """(row_id, ref_field, reason, at): each reference of each child row that finds no living parent.

    reason: 'missing' if no parent row has the key, else 'late' if the parent came after the row's time, else 'deleted'
    if it went at or before it. Null keys and rows without an id refer to nothing. Child rows that share an id are one
    row; a parent key that is repeated is taken as there from its earliest arrival to its latest removal. Times that are
    null make no case. Tables may be empty; other columns are not read.
    """
    spec = F.array(*[F.struct(F.lit(r.field).alias("ref_field"), F.lit(r.parent).alias("tab"), F.col(r.field).alias("key")) for r in refs])
    rows = (
        child.select(F.col(row_id).alias("rid"), F.col(at).alias("at"), F.explode(spec).alias("s"))
        .select("rid", "at", "s.ref_field", "s.tab", "s.key")
        .where("rid is not null and key is not null")
    )
    none = F.lit(None).cast("timestamp")
    long = rows.select("tab", "key", F.lit(0).alias("is_parent"), F.lit(1).alias("n"), F.col("at").alias("t_min"), F.col("at").alias("t_max"), none.alias("born"), none.alias("gone"), F.lit(0).alias("stays"))
    for r in {(r.parent, r.key, r.born, r.gone) for r in refs}:
        p = parents[r[0]]
        long = long.unionByName(
            p.where(p[r[1]].isNotNull()).select(
                F.lit(r[0]).alias("tab"), F.col(r[1]).alias("key"), F.lit(1).alias("is_parent"), F.lit(0).alias("n"), none.alias("t_min"), none.alias("t_max"),
                F.col(r[2]).alias("born"), F.col(r[3]).alias("gone"), F.col(r[3]).isNull().cast("int").alias("stays"),
            )
        )
    groups = long.groupBy("tab", "key").agg(
        F.max("is_parent").alias("has"), F.sum("n").alias("n"), F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"),
        F.min("born").alias("born"), F.max("gone").alias("gone"), F.max("stays").alias("stays"),
    )
    groups = groups.withColumn("gone", F.when(F.col("stays") == 0, F.col("gone")))
    case = "(has = 0 or t_min < born or t_max >= gone)"
    keys = cut(groups.where("n > 0").select("tab", "key", "has", "n", "born", "gone", F.expr(f"coalesce({case}, false)").alias("bad")))
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = keys.where(F.col("n") > max(1.0, total * HOT_SHARE)).select("tab", "key", "has", "born", "gone", "bad")
    cold = keys.where((F.col("n") <= max(1.0, total * HOT_SHARE)) & F.col("bad")).select("tab", "key", "has", "born", "gone")
    reason = F.when(F.col("has") == 0, "missing").when(F.col("born") > F.col("at"), "late").when(F.col("gone") <= F.col("at"), "deleted")
    found = ["rid", "ref_field", reason.alias("reason"), "at"]
    by_hot = rows.join(F.broadcast(hot.where("bad").drop("bad")), ["tab", "key"]).select(*found)
    rest = rows.join(F.broadcast(hot.select("tab", "key")), ["tab", "key"], "left_anti")
    by_cold = rest.join(cold, ["tab", "key"]).select(*found)
    out = by_hot.unionByName(by_cold).where("reason is not null")
    # redelivered rows repeat an id: one case for each id and field
    return out.groupBy("rid", "ref_field").agg(F.min(F.struct("at", "reason")).alias("m")).select(
        F.col("rid").alias(row_id), "ref_field", F.col("m.reason").alias("reason"), F.col("m.at").alias(at)
    )


def broken_reference_counts(child: DataFrame, parents: dict[str, DataFrame], refs: tuple[Reference, ...] = GRAPH_REFERENCES, row_id: str = "edge_id", at: str = "observed_at") -> DataFrame:
    """(ref_field, reason, day, n): cases per field, reason and UTC day of the child's time."""
    found = broken_references(child, parents, refs, row_id, at)
    return found.groupBy("ref_field", "reason", F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
