"""Per-key results when a few keys hold most rows: multi-level tree aggregation.

The input is combined where it lies, in chunks of CHUNK_ROWS rows, so that however often a hot key's row is repeated, a
chunk sends it on once. A key's states are then kept apart by a hash class of the value and merged in rounds of
``fan_in``, so that no task ever receives more than ``fan_in`` states of a key. Keys with few rows have few states from
the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.util import partitions

FAN_IN = 8
#: Input rows that are combined before anything is shuffled.
CHUNK_ROWS = 200_000


def _combine_chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def distinct() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            yield from t.group_by(t.column_names, use_threads=False).aggregate([]).to_batches()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= size:
                yield from distinct()
                held, rows = [], 0
        if rows:
            yield from distinct()

    return run


def distinct_in_chunks(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """df with the repeats within each chunk of that many input rows removed, without a shuffle."""
    return df.mapInArrow(_combine_chunks(chunk_rows), df.schema)


def tree_merge(states: DataFrame, keys: list[str], chunk: str, merge: dict[str, Column], n_chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge states (keys, chunk in 0..n_chunks-1, columns of merge) in logarithmically many rounds; one row per key."""
    while n_chunks > 1:
        n_chunks = -(-n_chunks // fan_in)
        states = states.withColumn(chunk, F.floor(F.col(chunk) / fan_in)).groupBy(*keys, chunk).agg(*[c.alias(k) for k, c in merge.items()])
    return states.drop(chunk)


def distinct_counts(df: DataFrame, key: str, value: str, out: str = "n", chunks: int | None = None, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, out): the number of distinct non-null values per key, hubs included.

    Repeats go within each chunk of chunk_rows input rows. A state holds a key's values of one of ``chunks`` hash
    classes: equal values always meet there, at most one from each input chunk, are counted once, and the counts of the
    classes only need adding. Rows with a null key are left out; a key whose values are all
    null gets 0; an empty table gives no rows; columns besides key and value are not read.
    """
    n = chunks or max(16, partitions(df.sparkSession))
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v")).where("k is not null")
    rows = distinct_in_chunks(rows, chunk_rows).withColumn("chunk", F.pmod(F.xxhash64("v"), F.lit(n)))
    # one placement serves the removal of the repeats of different chunks and the count of a class
    once = rows.repartition(F.col("k"), F.col("chunk")).dropDuplicates(["k", "chunk", "v"])
    states = once.groupBy("k", "chunk").agg(F.count("v").alias("n"))
    merged = tree_merge(states, ["k"], "chunk", {"n": F.sum("n")}, n, fan_in)
    return merged.select(F.col("k").alias(key), F.col("n").alias(out))


def row_counts(df: DataFrame, key: str, out: str = "n", chunks: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """(key, out): rows per key through the same tree; null keys count as one key."""
    n = chunks or max(16, partitions(df.sparkSession))
    rows = df.select(F.col(key).alias("k")).withColumn("chunk", F.pmod(F.spark_partition_id(), F.lit(n)))
    states = rows.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("n"))
    merged = tree_merge(states, ["k"], "chunk", {"n": F.sum("n")}, n, fan_in)
    return merged.select(F.col("k").alias(key), F.col("n").alias(out))


def caller_counts(edges: DataFrame) -> DataFrame:
    """(callee_id, n_callers): distinct callers of every callee of a call graph."""
    return distinct_counts(edges, "callee_id", "caller_id", "n_callers")


def fan_in_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, n_callers) of every node, repeated node rows once; n_callers is 0 where nothing calls it."""
    n = nodes.select("id", "fan_in", "is_external").distinct()
    counts = caller_counts(edges).withColumnRenamed("callee_id", "id")
    return n.join(counts, "id", "left").select("id", "fan_in", "is_external", F.coalesce("n_callers", F.lit(0)).alias("n_callers"))


def wrong_fan_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): internal nodes whose fan_in is null or is not the number of distinct callers."""
    return fan_in_report(nodes, edges).where("is_external = 0 and (fan_in is null or fan_in <> n_callers)").select("id").distinct()
