"""Queries p6 to p8 over ``documents`` and ``mix_targets``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import mixing, tokens, truncated
from canopy.session import table, written


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.token_ids(table(spark, sf, "documents"))


def p6_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, tokens, and how many texts their ids give back exactly, per language."""
    d = tokens.token_ids(table(spark, sf, "documents"), keep=("doc_id", "lang", "text"))
    back = tokens.decode(d, keep=("doc_id", "lang", "text", "ids"))
    same = F.col("bytes") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return back.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"), F.sum(same.cast("int")).alias("exact"))


def _mix(spark: SparkSession, sf: str):
    sized = written(tokens.token_counts(table(spark, sf, "documents").filter("source is not null"), keep=("doc_id", "source")), "mix-sizes")
    return mixing.mix(sized, table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen documents and how often each occurs."""
    return mixing.chosen(_mix(spark, sf)[0])


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.shares(*_mix(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncated.truncated(table(spark, sf, "documents")).select("doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of cut texts per source."""
    docs = table(spark, sf, "documents")
    return truncated.rates(docs, written(p8_found(spark, sf), "cut"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p6_ids, p6_roundtrip, p7_mix, p7_shares, p8_found, p8_rates)}


def oracle_sql() -> dict[str, str]:
    """SQL has no tokenizer; the trigram pipeline is tested against brute force."""
    return {}
