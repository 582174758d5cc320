"""Shared by the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandwork.util import partitions


def wide(df: DataFrame, *keys: str) -> DataFrame:
    """df in enough partitions for work that is slow per row.

    A scan of many splits stays as it is: its rows are worked on where they are read. Only a table that comes in fewer
    splits than there are cores is dealt out once by its keys.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(max(3 * cores, partitions(df.sparkSession)), *keys)
