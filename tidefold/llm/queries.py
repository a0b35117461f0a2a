"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.shared import fresh_dir, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import token_files

    path = fresh_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, path)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import decontaminate

    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rules of the query's contract.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path: bad if of low quality or toxic."""
    from tidefold.llm import url_filter

    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:\.html|/)?(?:[?#].*)?$", 1)
    shown = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    labelled = shown.join(labels, "doc_id").select("url", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return url_filter.judge(pages, URL_RULES, url_filter.fit(labelled))


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import preference

    turns = table(spark, sf_dir, "conversations")
    return preference.format_pairs(turns, preference.answered_by_next(turns), "conv_id")


def op5_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import near_dedup

    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import byte_bpe

    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import license_scan

    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.ALL)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import language

    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs.where(~language.held_out())))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import repetition

    return repetition.judge(table(spark, sf_dir, "documents"))


def op10_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import slots

    records, path = slots.measured(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "virtual_slot"), fresh_dir(spark, "slot-map")
    placed = slots.assign(records, path, slots.plan(records, path, 16))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from tidefold.llm import license_scan, oracles, preference

    return {
        "op2_decontaminate": oracles.decontaminate(),
        "op4_preference": preference.ORACLE,
        "op5_setsketch_dedup": oracles.near_duplicates(4, 80),
        "op7_license_scan": license_scan.oracle(license_scan.ALL),
        "op8_language_id": oracles.language(),
        "op9_quality_rules": oracles.quality(),
    }
