"""The queries of this subpackage and their SQL; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprints, mixing, near, pages, quality, repeats, templates, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.template_report(_documents(spark, sf_dir))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(chat.paired(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_join(_documents(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_report(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_documents(spark, sf_dir)).drop("lost_chars")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_chat_formatting, op3_document_fingerprints, op4_jaccard_join, op5_source_mixing,
        op6_warc, op7_byte_bpe, op8_suffix_dedup, op9_quality_rules, op10_html_extraction,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": templates.SQL, "op2_chat_formatting": chat.SQL, "op4_jaccard_join": near.SQL, "op5_source_mixing": mixing.SQL,
    "op8_suffix_dedup": repeats.SQL, "op9_quality_rules": quality.SQL,
}
