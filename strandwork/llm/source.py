"""Operators over source files: which do not parse, and functions paired with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.doctext import clean, informative
from strandwork.llm.functions import Found, find_functions
from strandwork.llm.syntax.check import check, extension_language, lex, parse_tokens
from strandwork.util import partitions, trim_all


def _once(df: DataFrame, key: str, *columns: str, order: str) -> DataFrame:
    """One row per id, the last by order (where there is such a column) and then by the columns themselves, dealt out for
    work that is slow per row; rows without an id name nothing and are left out."""
    n = max(3 * df.sparkSession.sparkContext.defaultParallelism, partitions(df.sparkSession))
    by = [c for c in (order,) if c in df.columns] + list(columns)
    rows = df.select(key, F.struct(*by).alias("_by"), F.struct(*columns).alias("_r")).where(F.col(key).isNotNull()).repartition(n, key)
    return rows.groupBy(key).agg(F.max_by("_r", "_by").alias("_r")).select(key, "_r.*")


def check_files(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, valid, line, col, cause) of each file whose extension stands for a known language.

    language is the one that the extension of file_path stands for. Null content and other extensions give no row; rows
    that share a file_id are one file; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, repo, path, text in zip(b.file_id, b.repo, b.file_path, b.content):
                v = check(text, path)
                if v is not None:
                    rows.append((i, repo, v.language, v.valid, v.line, v.column, v.cause))
            yield pd.DataFrame(rows, columns=["file_id", "repo", "language", "valid", "line", "col", "cause"])

    kind = dict(files.dtypes)["file_id"]
    some = files.where("content is not null and file_path is not null")
    return _once(some, "file_id", "repo", "file_path", "content", order="scanned_at").mapInPandas(run, f"file_id {kind}, repo string, language string, valid boolean, line int, col int, cause string")


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id) of the files that do not parse."""
    return check_files(files).where("not valid").select("file_id")


def invalid_rates(files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, rate, n_conflict, n_truncated, n_extension, n_syntax) per repo and language."""
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0))
    causes = ["conflict", "truncated", "extension"]
    return check_files(files).groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("n_files"), bad(~F.col("valid")).alias("n_invalid"), (bad(~F.col("valid")) / F.count(F.lit(1))).alias("rate"),
        *[bad(F.col("cause") == c).alias(f"n_{c}") for c in causes], bad(F.col("cause").isin("syntax", "nesting")).alias("n_syntax"),
    )


def _documented(text: str, kind: str) -> list[Found]:
    """The functions with documentation that says something, of a text that parses. Parsing costs most, so a text without
    such a function is not parsed."""
    tokens = lex(text, kind)
    try:
        told = [f for f in find_functions(tokens, kind) if informative(f.doc, f.name)]
    except IndexError:
        # a text that breaks off does not parse
        if parse_tokens(tokens, kind)[0]:
            raise
        return []
    return told if told and parse_tokens(tokens, kind)[0] else []


def file_pairs(files: DataFrame) -> DataFrame:
    """(origin, record_id, name, line, code, description) of the documented functions of files that parse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, path, text in zip(b.file_id, b.file_path, b.content):
                found = extension_language(path)
                if found is None or found[1] == "json" or not text:
                    continue
                for f in _documented(text, found[1]):
                    rows.append(("file", i, f.name, f.line, text[f.start : f.end], clean(f.doc)))
            yield pd.DataFrame(rows, columns=["origin", "record_id", "name", "line", "code", "description"])

    some = files.where("content is not null and file_path is not null")
    return _once(some, "file_id", "file_path", "content", order="scanned_at").mapInPandas(run, "origin string, record_id long, name string, line int, code string, description string")


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    """The same of insertion candidates: the signature as code, line 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                ("candidate", i, name, 0, signature, clean(doc))
                for i, name, signature, doc in zip(b.candidate_id, b.name, b.signature, b.docstring)
                if informative(doc, name)
            ]
            yield pd.DataFrame(rows, columns=["origin", "record_id", "name", "line", "code", "description"])

    some = candidates.where(F.col("docstring").isNotNull() & F.col("signature").isNotNull() & (F.length(trim_all(F.col("signature"))) > 0))
    return _once(some, "candidate_id", "name", "signature", "docstring", order="requested_at").mapInPandas(run, "origin string, record_id long, name string, line int, code string, description string")


def documented_functions(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Code-description pairs of files and candidates, without functions whose documentation is missing or trivial.

    Rows that share an id are one record; null content, signature or docstring gives no pair; other columns are not
    read. description is the documentation without its comment marks.
    """
    return file_pairs(files).unionByName(candidate_pairs(candidates))
