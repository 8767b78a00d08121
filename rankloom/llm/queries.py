"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import bpe, conversations, divergence, fingerprints, language, licenses, matroska, mixing, sharding, simhash, suffixes, toxicity, warc
from rankloom.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_quality(mixing.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return mixing.mix(docs, size=F.col("size"), quality=F.col("quality_weight"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.deal(table(spark, sf_dir, "documents"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_suffix_dedup, op2_language, op3_bpe, op4_licenses, op5_fingerprints, op6_mixing, op7_sharding, op8_matroska, op9_warc, op10_simhash, op11_toxicity, op12_divergence, op13_conversation_repair)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.ORACLE, "op9_warc": warc.ORACLE, "op12_divergence": divergence.ORACLE}
