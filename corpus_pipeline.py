"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakfold.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from peakfold.llm.common import documents, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; those without letters (null and empty texts
    too) or in none go.  Columns, nulls in others and repeated rows stay as they are."""
    return language_id.in_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id (null below all others); null counts as
    empty, and of rows that repeat one stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (runs of five words, similarity of 0.8 or more), that
    with the smallest doc_id."""
    return near_dedup.deduplicated(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as its source's target takes it; a null source is one of its own,
    and a document without words is taken once."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the check sums of ids and decoded bytes; null counts as empty."""
    return bpe.encoded(docs, with_ids=True)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("byte-level BPE", encode)]

#: The stages learn and hash in ways that SQL has no words for; the operators are tested against brute
#: force, the stages by the documents that stay.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, f"stage{n}")
    return docs
