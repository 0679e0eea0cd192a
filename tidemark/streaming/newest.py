"""Newest-wins deduplication of a stream, in state that the watermark clears."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import tables


def newest_wins(stream: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], lateness: str) -> DataFrame:
    """The newest rows of keys, by `at` and then `order` (null and NaN lowest), whenever they change.

    Time is cut into windows as long as `lateness`, and a key's state in a window is its newest row alone.  A window's state
    goes once the watermark has passed its end: rows of closed windows are dropped, and those of open ones still count.
    Written in update mode, the newest row of each key in the log is the winner (`keep_newest`, `read_newest`)."""
    columns = list(stream.columns)
    floats = {c for c, t in stream.dtypes if t in ("float", "double")}
    rank = F.struct(at, *(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in order))
    values = F.struct(*(c for c in columns if c not in keys))
    watched = stream.filter(F.col(at).isNotNull()).withWatermark(at, lateness)
    newest = watched.groupBy(F.window(at, lateness), *keys).agg(F.max_by(values, rank).alias("__r"))
    return newest.select(*(F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in columns))


def keep_newest(winners: DataFrame, path: str, checkpoint: str, keys: Sequence[str]):
    """Append each batch of winners to a log under `path` until all that has landed is processed; a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("entity_id", F.concat_ws("\x1f", *(F.col(k).cast("string") for k in keys)))
        tables.append(rows, path, number)

    query = winners.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_newest(spark, path: str, keys: Sequence[str], at: str, order: Sequence[str]) -> DataFrame:
    """The winner of each key of such a log."""
    log = spark.read.option("basePath", path).parquet(path)
    values = [c for c in log.columns if c not in ("batch", "bucket", "entity_id", *keys)]
    floats = {c for c, t in log.dtypes if t in ("float", "double")}
    rank = [F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in order]
    newest = F.max_by(F.struct(*values), F.struct(at, *rank, "batch"))
    return log.groupBy(*keys).agg(newest.alias("__r")).select(*keys, "__r.*")
