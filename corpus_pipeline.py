"""A training corpus from ``documents``: good texts, one of each near copy, no repeats, no secrets, packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyvine.llm import queries
from tallyvine.llm.classifier import fit_quality, keep_good
from tallyvine.llm.ngram_join import keep_one
from tallyvine.llm.packing import pack
from tallyvine.llm.secret_scan import redact_secrets
from tallyvine.llm.substring_dedup import remove_repeats
from tallyvine.sources.scratch import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = fit_quality(docs, queries.labels_to_learn_from(spark, sf_dir))
    return keep_good(docs, model, queries.GOOD_FROM)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that were met before."""
    return remove_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets blanked out."""
    return redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of equal length."""
    # Workers of all stages share the memory of a machine.
    return pack(docs, public_tokenizers.path(queries.WORD_VOCABULARY), remembered_bytes=32 << 20)


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("secret scans", secrets),
    ("packing", packed),
]

#: The classifier, the chunks and the vocabulary have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on the stored result of the one before."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
