"""Incremental loads as Structured Streaming jobs that run until what has landed is processed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import pit
from tidemark.sources import tables


def follow(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """A stream of the files in a folder, old and new; zone-less timestamps become timestamps, which watermarks need."""
    df = spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_batch).load(path)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def merge_into(stream: DataFrame, table: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, after: Callable[[DataFrame], None] | None = None):
    """Append each micro-batch to a merged table; a batch that is run again replaces itself, so rows count once.

    `after` may recompute what the batch touches, as superseded originals or derived partitions."""

    def put(batch: DataFrame, number: int) -> None:
        rows = prepare(batch).persist()
        tables.append(rows, table, number)
        if after is not None:
            after(rows)
        rows.unpersist()

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sweep_amendments(filings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Filings (accession, availability_date, restated_at, amended) after all has landed: originals get the date of their first later amendment.

    It may run after any flush, or once at the end: the outcome depends on what is stored, not on the order of arrival."""
    return pit.supersede(filings.filter("not amended"), filings.filter("amended"), keys).unionByName(filings.filter("amended"))


def daily_status(filings: DataFrame) -> DataFrame:
    """(day, filings, amendments, superseded) of swept filings."""
    count = lambda c: F.sum(c.cast("long"))
    return filings.groupBy(F.col("availability_date").alias("day")).agg(F.count(F.lit(1)).alias("filings"), count(F.col("amended")).alias("amendments"), count(~F.col("amended") & F.col("restated_at").isNotNull()).alias("superseded"))
