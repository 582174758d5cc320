"""Queries p4, p6, p8, p9 and p10. They are checked by round trips, brute force and held-out labels, not by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwork.llm import bpe, langid, packing, source
from strandwork.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d).select("origin", "record_id", "name", "line")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return source.documented_functions(table(spark, d, "source_files"), table(spark, d, "insertion_candidates"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return source.invalid_files(table(spark, d, "source_files"))


def p6_failures(spark: SparkSession, d: str) -> DataFrame:
    return source.check_files(table(spark, d, "source_files")).where("not valid").drop("valid")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return source.invalid_rates(table(spark, d, "source_files"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p9_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_summary(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.language_cases(table(spark, d, "documents"))


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_pairs, p6_found, p6_failures, p6_rates, p8_ids, p9_containers, p9_summary, p10_found, p10_stretches)}
SQL: dict[str, str] = {}
