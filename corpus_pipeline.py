"""The corpus pipeline: toxic and poor documents go, one of each group of near-duplicates stays, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import neardup, packing, quality, toxicity
from tidemark.llm.common import stored, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled learner does not call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network calls good."""
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component at five-word shingles and similarity 0.8."""
    return neardup.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences along the space-filling curve."""
    return packing.op7(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality", remove_poor),
    ("near_duplicates", remove_near_duplicates),
    ("packing", pack),
]

#: SQL can express neither the trained classifiers nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
