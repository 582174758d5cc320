"""Ordered computations per key that hold for a key with a third of all rows: running sums and as-of joins by slices.

A key's rows are cut into slices of time. Within a slice a window does the work; between slices only one small row per
key and slice takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.util import cut

SLICE_US = 6 * 3600 * 1_000_000


def _slice(ts: Column, slice_us: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / slice_us)


def running_count(df: DataFrame, keys: list[str], ts: str, order: list[str], flag: Column, out: str, slice_us: int = SLICE_US) -> DataFrame:
    """df with out: how many rows of the key with flag lie at or before the row, in the order of ts and order."""
    rows = df.withColumn("_slice", _slice(F.col(ts), slice_us)).withColumn("_flag", F.coalesce(flag.cast("int"), F.lit(0)))
    per = rows.groupBy(*keys, "_slice").agg(F.sum("_flag").alias("_n"))
    before = per.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_n")).drop("_n")
    w = Window.partitionBy(*keys, "_slice").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_own", F.sum("_flag").over(w)).join(before, [*keys, "_slice"]).withColumn(out, F.col("_own") + F.col("_before")).drop("_slice", "_flag", "_own", "_before")


def as_of_forward(left: DataFrame, right: DataFrame, key: str, ts: str, out: str, slice_us: int = SLICE_US) -> DataFrame:
    """left with out: the ts of the first right row of the same key strictly later, null where none is."""
    a = left.withColumn("_slice", _slice(F.col(ts), slice_us)).withColumn("_left", F.lit(1))
    b = right.select(key, ts).withColumn("_slice", _slice(F.col(ts), slice_us))
    firsts = b.groupBy(key, "_slice").agg(F.min(ts).alias("_first"))
    # the first right row after each slice: over one row per key and slice of either side
    ends = firsts.unionByName(a.select(key, "_slice").distinct().withColumn("_first", F.lit(None).cast("timestamp"))).groupBy(key, "_slice").agg(F.min("_first").alias("_first"))
    w = Window.partitionBy(key).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    after = ends.select(key, "_slice", F.min("_first").over(w).alias("_after"))
    both = a.unionByName(b.withColumn("_right", F.col(ts)), allowMissingColumns=True)
    # of the right rows from here on the least that is later: the distinct ts behind the current one
    later = F.min(F.struct(F.col("_right").isNull(), "_right")).over(Window.partitionBy(key, "_slice").orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(1, Window.unboundedFollowing))
    found = both.withColumn("_next", later["_right"]).where("_left = 1")
    return found.join(after, [key, "_slice"], "left").withColumn(out, F.coalesce("_next", "_after")).drop("_slice", "_left", "_right", "_next", "_after")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """df with out: the row's number 1.. within its key in the order given, which must be total.

    Rows are dealt out by ranges of key and order, numbered within each range, and moved on by the number of rows of the
    key in the ranges before; so no task needs all rows of a key.
    """
    r = cut(df.repartitionByRange(*[F.asc(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    per = r.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = per.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n"))
    before = before.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), "_before")
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = r.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    return own.join(before, same).withColumn(out, (F.col("_own") + F.col("_before")).cast("int")).select(*df.columns, out)
