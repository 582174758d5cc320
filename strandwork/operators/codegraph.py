"""Call graphs out of source files: functions, call sites and the resolution of calls to functions.

Extraction scans each file once (scanner.py: TypeScript, JavaScript, Python, Go, Rust, Ruby, Java, C++, Swift), in Arrow batches, and gives two kinds of rows; everything after that is joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.operators.scanner import LANGUAGE, Lines, scan
from strandwork.util import cut, partitions

SITES = (
    "kind string, file_path string, id string, name string, class_name string, is_async boolean, start_line int, end_line int, complexity int, caller_id string, callee_name string, callee_object string, line int, call_type string"
)


def _language(path: str) -> str | None:
    return LANGUAGE.get(path.rsplit(".", 1)[-1].lower())


def scan_file(path: str, text: str) -> list[tuple]:
    """Rows of SITES: 'function' for each function of the file, 'call' for each call inside one."""
    lang = _language(path)
    if lang is None:
        return []
    got, lines = scan(text, lang), Lines(text)
    ids = [f"{path}::{f.class_name}.{f.name}" if f.class_name else f"{path}::{f.name}" for f in got.functions]
    rows: list[tuple] = [
        ("function", path, i, f.name, f.class_name, f.is_async, lines.of(f.start), lines.of(max(f.start, f.end - 1)), f.complexity, None, None, None, lines.of(f.at), None)
        for i, f in zip(ids, got.functions)
    ]
    rows += [("call", path, None, None, None, None, None, None, None, ids[k], name, obj, lines.of(at), kind) for k, name, obj, at, kind in got.calls]
    return rows


UNITS = "file_id long, name string, class_name string, start_line int, end_line int, start long, code string"


def _units(path: str, text: str) -> list[tuple]:
    """(name, class_name, start_line, end_line, start, code) of each function, from its declaration to the end of its body."""
    lang = _language(path)
    if lang is None:
        return []
    lines = Lines(text)
    return [(f.name, f.class_name, lines.of(f.start), lines.of(max(f.start, f.end - 1)), f.start, text[f.start : f.end]) for f in scan(text, lang).functions]


def function_units(files: DataFrame) -> DataFrame:
    """The code of each function of the files (UNITS), one pass over each file_id's text; null content gives none."""
    n = max(3 * files.sparkSession.sparkContext.defaultParallelism, partitions(files.sparkSession))
    one = files.select("file_id", "file_path", "content").where("file_id is not null and file_path is not null and content is not null").repartition(n, "file_id").dropDuplicates(["file_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in UNITS.split(", ")]
        for b in batches:
            yield pd.DataFrame([(i, *r) for i, p, x in zip(b.file_id, b.file_path, b.content) for r in _units(p, x)], columns=columns)

    return one.mapInPandas(run, UNITS)


def code_sites(files: DataFrame) -> DataFrame:
    """Functions and call sites of source files (SITES), one pass over each path's text; null content gives none."""
    n = max(3 * files.sparkSession.sparkContext.defaultParallelism, partitions(files.sparkSession))
    one = files.select("file_path", "content").where("file_path is not null and content is not null").repartition(n, "file_path").dropDuplicates(["file_path"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SITES.split(", ")]
        for b in batches:
            rows = [r for p, x in zip(b.file_path, b.content) for r in scan_file(p, x)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"start_line": "Int32", "end_line": "Int32", "complexity": "Int32", "is_async": "boolean"})

    return one.mapInPandas(run, SITES)


def build_call_graph(files: DataFrame, imported: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(functions, edges) of source files.

    functions (id, name, class_name, file_path, is_async, start_line, end_line, complexity); edges (caller_id, callee_id,
    callee_name, line, call_type, confidence). A call is resolved by the first strategy that finds a function: 'self_cls'
    (a method of the caller's class, called on this or self), 'type_name' (a method of the class that the object is named
    for), 'import' (a function of a file that the caller's file imports; imported (file_path, target_path)), 'same_file',
    'name_only' (the only function of that name anywhere); what is left is 'external' with an external:: id.
    """
    sites = cut(code_sites(files))
    fn = sites.where("kind = 'function'").select("id", "name", "class_name", "file_path", "is_async", "start_line", "end_line", "complexity").dropDuplicates(["id"])
    calls = sites.where("kind = 'call'").select("caller_id", "file_path", "callee_name", "callee_object", "line", "call_type")
    calls = cut(calls.join(fn.select(F.col("id").alias("caller_id"), F.col("class_name").alias("caller_class")), "caller_id", "left").withColumn("call_no", F.monotonically_increasing_id()))
    f = fn.select(F.col("id").alias("callee_id"), F.col("name").alias("callee_name"), F.col("class_name").alias("cls"), F.col("file_path").alias("def_file"))
    one = lambda df, keys: df.groupBy(*keys).agg(F.min("callee_id").alias("callee_id"))
    own = calls.where("callee_object in ('this', 'self')").select("call_no", "callee_name", "file_path", F.col("caller_class").alias("cls"))
    found = [own.join(one(f.withColumnRenamed("def_file", "file_path"), ["callee_name", "cls", "file_path"]), ["callee_name", "cls", "file_path"]).select("call_no", "callee_id", F.lit(0).alias("o"))]
    typed = calls.where("callee_object is not null").select("call_no", "callee_name", F.lower("callee_object").alias("cls"))
    found.append(typed.join(one(f.where("cls is not null").withColumn("cls", F.lower("cls")), ["callee_name", "cls"]), ["callee_name", "cls"]).select("call_no", "callee_id", F.lit(1).alias("o")))
    if imported is not None:
        i = calls.select("call_no", "callee_name", "file_path").join(imported.select("file_path", F.col("target_path").alias("def_file")).distinct(), "file_path")
        found.append(i.join(one(f, ["callee_name", "def_file"]), ["callee_name", "def_file"]).groupBy("call_no").agg(F.min("callee_id").alias("callee_id")).select("call_no", "callee_id", F.lit(2).alias("o")))
    plain = calls.where("callee_object is null or callee_object in ('this', 'self')").select("call_no", "callee_name", F.col("file_path").alias("def_file"))
    found.append(plain.join(one(f, ["callee_name", "def_file"]), ["callee_name", "def_file"]).select("call_no", "callee_id", F.lit(3).alias("o")))
    single = f.groupBy("callee_name").agg(F.count(F.lit(1)).alias("n"), F.min("callee_id").alias("callee_id")).where("n = 1")
    found.append(calls.select("call_no", "callee_name").join(single, "callee_name").select("call_no", "callee_id", F.lit(4).alias("o")))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    best = every.groupBy("call_no").agg(F.min(F.struct("o", "callee_id")).alias("m"))
    names = F.array(*map(F.lit, ("self_cls", "type_name", "import", "same_file", "name_only")))
    edges = calls.join(best, "call_no", "left").select(
        "caller_id", F.when(F.col("m").isNotNull(), F.col("m.callee_id")).otherwise(F.concat(F.lit("external::"), F.concat_ws(".", "callee_object", "callee_name"))).alias("callee_id"), "callee_name", "line", "call_type",
        F.when(F.col("m").isNull(), "external").otherwise(F.element_at(names, F.col("m.o") + 1)).alias("confidence"),
    )
    return fn, edges
