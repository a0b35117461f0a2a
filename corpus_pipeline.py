"""A corpus through quality rules, language ID, near-deduplication, decontamination and tokenisation.

Each stage gets what its predecessor kept, as a DataFrame with the columns of documents, and its decisions take
effect; the last one returns token counts and digests.

Documents without a text, or with an empty one, fail the quality rules; a null language or source plays no part (rows
without a language teach nothing); a null doc_id is an id like others and the last to stay in its group. Very long
texts are judged, compared and encoded whole. Repeated rows and copies leave one row; of equal ids with different texts
both stay. Further columns, whatever their names, pass through all stages but the last, which returns its own. Empty
tables go through and give no rows; without test items nothing is removed; without labelled languages the language
stage knows no language and keeps nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidefold.llm import byte_bpe, decontaminate, language, near_dedup, repetition
from tidefold.llm.shared import dropped, fresh_dir, table, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    training = docs.where(~language.held_out())
    profiles = language.fit(training)
    return language.keep(docs, profiles, least=language.calibrate(training, profiles))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL cannot express the suffix arrays, profiles and merges; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again, and its tables between
    and its predecessor's rows are removed."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, path = path, fresh_dir(spark, name)
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            dropped(spark, before)
        docs = spark.read.parquet(path)
    return docs
