"""The registered opN_ queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from probatio.llm import chat, decontamination, language, licenses, mixing, near_duplicates, ppm, quality, toxicity, warc
from probatio.llm.common import checkpointed, table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(checkpointed(warc.write_bundles(table(spark, sf_dir, "pages"))))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op6_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_chat_formatting, op3_quality_rules, op4_warc_bundles, op5_jaccard_join, op6_ppm_scoring, op7_language_id, op8_toxicity, op9_source_mixing, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.SQL, "op3_quality_rules": quality.sql(), "op4_warc_bundles": warc.SQL, "op9_source_mixing": mixing.SQL, "op10_license_scan": licenses.sql()}
