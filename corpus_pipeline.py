"""Corpus pipeline: documents -> quality -> one of each group of near-duplicates -> mix of sources -> token ids.

Every stage takes what its predecessor kept, as a written table, and decides on all of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslight.llm import bpe, minhash, mixing, quality
from presslight.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; the others go.

    A null text counts as empty, and its score decides as any other's; repeated rows and equal ids are decided
    row by row, very long texts by all their words. An empty table stays empty. Other columns pass, whatever their names.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.good_documents(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with shingles of five words and similarity 0.8 or more: that of the smallest id.

    Null, empty and blank texts and rows with a null id stay; of rows with one id one stays. An empty table stays empty.
    """
    return minhash.deduplicated(docs, n=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    A null source is one of its own; texts without words take no share and come with the document before them. An empty
    table stays empty. Other columns pass, whatever their names.
    """
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty, repeated rows have a row each, an empty table gives none; other columns are not read.
    """
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The classifier and the tokenizer can't be expressed in SQL; tests/llm hold the pipeline against its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
