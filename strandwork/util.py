"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests) and
    an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if (app, named) not in _OWN_DIR:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = named.rstrip("/") if named else tempfile.mkdtemp(prefix="strandwork-")
        _OWN_DIR[app, named] = f"{base}/strandwork/{app}"
        # whatever the queries of this application leave is deleted with it
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_OWN_DIR[app, named])
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _OWN_DIR[app, named]


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*dfs: DataFrame) -> None:
    """Delete the files behind tables made by cut() that nothing will read again."""
    for df in dfs:
        sc = df.sparkSession.sparkContext
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/strandwork/" in name:
                path = sc._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim_all(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    space = "[\\s\\x0B\\x1C-\\x1F\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
    return F.regexp_replace(c, f"^{space}|{space}$", "")


def js_round(c: Column) -> Column:
    """Round half up, as floor(x + 0.5)."""
    return F.floor(c + F.lit(0.5))
