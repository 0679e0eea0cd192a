"""Bounded, repeatable training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def fold(doc_id: str, folds: int) -> Column:
    """The fold of a document: crc32 of the id as text, modulo the number of folds."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds).cast("int")


def held_out(doc_id: str, folds: int, test_fold: int) -> Column:
    """Whether a document is in the held-out fold; false for a null id."""
    return F.coalesce(fold(doc_id, folds) == test_fold, F.lit(False))


def pick(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """The `n` rows whose doc_id hashes lowest: a top-k, whatever the table's size or layout."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def sampled(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """The rows of `picked` (doc_id and what else; bounded, so broadcast) with their whole texts; a repeated doc_id counts once."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return texts.join(F.broadcast(picked), "doc_id")


def texts_of(docs: DataFrame, picked: DataFrame, seed: int, most_bytes: int) -> list:
    """`sampled` on the driver, in order of doc_id: the texts whose ids hash lowest, until they have `most_bytes` bytes together.

    Both bounds, of rows (those of `picked`) and of bytes, hold whatever the texts are: the sums are over the sample's rows alone."""
    rows = stored(sampled(docs, picked.dropDuplicates(["doc_id"])), "sample")
    upto = Window.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("n")).withColumn("total", F.sum("n").over(upto))
    kept = rows.join(F.broadcast(sizes.filter(F.col("total") <= most_bytes).select("doc_id")), "doc_id")
    return sorted(kept.collect(), key=lambda r: r.doc_id)
