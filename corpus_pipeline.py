"""The corpus pipeline: quality classifier, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents; a stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import near_dup, packing, quality, suffix_dedup
from textloom.llm.shared import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents among those that it is given."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return near_dup.one_of_each(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages of 50 bytes and more that documents with smaller ids hold; all documents stay."""
    return suffix_dedup.clean(docs, length_column="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("near_dup", near_dup_stage), ("suffix_dedup", suffix_dedup_stage), ("packing", packing_stage)]

#: The stages run trained and iterative operators that SQL can't express; a test holds each stage's rows against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
