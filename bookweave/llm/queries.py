"""The p6..p8 queries. SQL cannot express them; tests hold them against libraries and brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookweave.llm import leakage, residue, tokenize
from bookweave.session import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.with_ids(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p8_found)}
SQL: dict[str, str] = {}
