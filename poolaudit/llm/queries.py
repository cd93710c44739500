"""Queries of the training-data problems, and their SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from poolaudit.llm import cutoff, ledger, mixing, neardup, overlap, pairs, pieces, tokens
from poolaudit.storage import ship


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_overlaps(_table(spark, d, "pool"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_table(spark, d, "pool"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.duplicates(_table(spark, d, "pool"))


def p2_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.copies(_table(spark, d, "pool"))[0].select("first", "copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, d, "pool"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_table(spark, d, "pool"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(_table(spark, d, "labelled_mix"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_rows(_table(spark, d, "decision_pool"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.rates(_table(spark, d, "decision_pool"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(_table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "doc_sources"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "doc_sources"))[1]


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(_table(spark, d, "documents"), _table(spark, d, "doc_sources"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_report, p2_found, p2_ledger, p3_found, p3_groups, p4_found, p5_found, p5_rates, p6_ids, p7_mix, p7_shares, p8_pieces)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
