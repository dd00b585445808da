"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``, whatever further ones there are. An empty
table gives an empty result in every stage, very long texts are taken whole,
and a null ``lang`` or ``n_chars`` is of no consequence.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sheetwright.llm import bpe, mixing, near, quality, templates
from sheetwright.llm.common import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, as do lines above the limits.

    Null, empty and short texts are rejected; a null source is a host of its
    own; repeated rows stay or go together and count as one document.
    """
    return quality.quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go.

    Every row stays: a null text is null afterwards, and a text of recurring
    lines only is empty. Repeated rows lose the same lines.
    """
    return templates.drop_templates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least doc_id, null last.

    Texts without words, null ones too, are one class; of repeated rows one stays.
    """
    return near.near_filter(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets.

    A null source is a source of its own; documents without words follow
    their source's rate, and go if all of it has none. Rows of one doc_id,
    null ones too, draw alike.
    """
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document; a null text is empty, repeated rows each get their row."""
    return bpe.token_report(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_stage),
    ("source_mixing", mix_stage),
    ("byte_bpe", token_stage),
]

#: SQL can express neither the minhash join nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
