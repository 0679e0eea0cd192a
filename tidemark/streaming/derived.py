"""Derived tables kept up to date: late rows recompute the partitions that they can change, and no other.

A derived table is laid out by date and entity bucket.  Each refresh writes the touched partitions into a folder of its own,
and then one line for each of them into the table's list of parts; readers take the newest part of each partition.  A job
that dies before the list is written leaves the old table whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.sources import tables
from tidemark.sources.scratch import stored

PARTS = "day string, bucket int, version long, rows long"


def touched(batch: DataFrame, dates: Sequence, buckets: int = tables.BUCKETS) -> list[tuple[str, int]]:
    """The partitions (day, bucket) that rows can change: dates from the earliest availability of each bucket's rows on.

    Of the batch only one date for each bucket comes to the driver."""
    first = batch.groupBy(tables.bucket_of(buckets=buckets).alias("b")).agg(F.min("availability_date").alias("d")).collect()
    return sorted((str(t), r.b) for r in first for t in dates if r.d is not None and t >= r.d)


def parts(spark: SparkSession, path: str) -> DataFrame | None:
    """(day, bucket, version, rows): the newest part of each partition; nothing before the first refresh."""
    try:
        log = spark.read.schema(PARTS).parquet(f"{path}/_parts")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return log.groupBy("day", "bucket").agg(F.max("version").alias("version"), F.max_by("rows", "version").alias("rows"))


def refresh(spark: SparkSession, log: str, path: str, batch: DataFrame, version: int, dates: Sequence, keys: Sequence[str], summarise: Callable[[DataFrame], DataFrame], buckets: int = tables.BUCKETS) -> list[tuple[str, int]]:
    """Recompute the partitions of `path` that a batch just appended to `log` can change; returns them.

    `summarise` maps states (t, facts' columns) to rows with t and entity_id.  Only the touched buckets of the log are read.
    The same version again replaces itself."""
    changed = touched(batch, dates, buckets)
    if not changed:
        return []
    wanted = spark.createDataFrame([(d, b) for d, b in changed], "day string, bucket int").select(F.to_date("day").alias("t"), "bucket")
    rows = spark.read.option("basePath", log).parquet(log).filter(F.col("bucket").isin(sorted({b for _, b in changed})))
    facts = stored(tables.merged(rows, keys))  # the spine and the join read them
    if facts.filter("restated_at is not null").isEmpty():  # a literal lets the planner leave out what withdrawn versions need
        facts = facts.withColumn("restated_at", F.lit(None).cast(facts.schema["restated_at"].dataType))
    spine = facts.select("entity_id", "bucket").distinct().join(F.broadcast(wanted), "bucket").select("entity_id", "t")  # dates times buckets
    state = summarise(pit.as_of_join(spine, facts.drop("bucket"), keys))
    out = state.withColumns({"day": F.col("t").cast("string"), "bucket": tables.bucket_of(buckets=buckets)})
    out.repartition("day", "bucket").write.mode("overwrite").partitionBy("day", "bucket").parquet(f"{path}/version={version:012d}")
    # a partition that has become empty has a part without rows, so that the older one no longer counts
    written = spark.read.schema(out.schema).parquet(f"{path}/version={version:012d}").groupBy("day", "bucket").agg(F.count("*").alias("rows"))
    named = wanted.select(F.col("t").cast("string").alias("day"), "bucket").join(written, ["day", "bucket"], "left")
    listed = named.select("day", "bucket", F.lit(version).cast("long").alias("version"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/_parts/v={version:012d}")
    return changed


def read(spark: SparkSession, path: str) -> DataFrame:
    """The current rows: the newest part of each partition, read by its folder; as many folders as dates times buckets."""
    found = parts(spark, path)
    if found is None:
        raise ValueError(f"{path} has not been refreshed")
    folders = [f"{path}/version={r.version:012d}/day={r.day}/bucket={r.bucket}" for r in found.filter("rows > 0").collect()]
    return spark.read.option("basePath", path).parquet(*folders).drop("version", "day", "bucket")
