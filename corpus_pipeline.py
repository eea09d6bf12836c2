"""The corpus pipeline: documents in, a clean and weighted mix out.

Every stage takes the documents that the stage before it kept, written as Parquet and read again. All stages but the
last return the columns of ``documents``; the last returns the mix: how many words of which document it takes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from probatio.llm import decontamination, language, mixing, near_duplicates, quality
from probatio.llm.common import checkpoint_folder, remove_folder, table

#: A prediction less sure than this is a rejection, as is one of no language. Of the held-out documents of sf0.1 one in
#: a thousand scores less; texts in languages that were not learned and letter soup score below 1e-6.
LEAST_LANGUAGE_SCORE = 0.01


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the classifier knows."""
    return language.keep_known(docs, LEAST_LANGUAGE_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the current policy of the rule ledger."""
    return quality.keep_good(docs)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return near_duplicates.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take of every document, so that sources meet their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_removal),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
]

#: Trained, pruned and verified stages have no SQL; tests/llm holds the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the documents that all stages keep. A stage's output goes once the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
