"""Canonical tables on plain Parquet: bucketed, merged by appending, versioned by directory.

A table is a folder of batches, each written once: `batch=<id>/bucket=<b>/`.  Readers keep the newest row of each write
key by batch id, so a repeated batch changes nothing.  `compact` writes a new version folder; a small pointer table says
which version is current.  Nothing is ever overwritten in place, so a job that dies leaves the old state whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(column: str = "entity_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def write_key(keys: Sequence[str]) -> list[str]:
    """What a re-ingested row replaces: the same reference to the same fact, whatever its availability."""
    return list(dict.fromkeys(["entity_id", "effective_date", "source_ref", *keys]))


def append(df: DataFrame, path: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Write one batch; the same batch again replaces itself and nothing else."""
    rows = df.withColumn("bucket", bucket_of(buckets=buckets)).repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id:012d}")


def merged(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of a log with `batch`, the newest row of each write key: of the latest batch, there the one available, then recorded, last.

    Rows of a key that agree in all that are told apart by a hash of the whole row, so the pick never depends on layout."""
    later = [F.desc_nulls_last(c) for c in ("batch", "availability_date", "recorded_at") if c in log.columns]
    w = Window.partitionBy(*write_key(keys)).orderBy(*later, F.desc(F.xxhash64(*(F.col(c) for c in log.columns if c != "batch"))))
    return log.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place", "batch")


def read(spark: SparkSession, path: str, keys: Sequence[str], entities: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The merged table; with entities, only their buckets' files are listed and read."""
    log = spark.read.option("basePath", path).parquet(path)
    if entities is not None:
        ids = spark.createDataFrame([(e,) for e in entities], "entity_id string")
        wanted = [r.b for r in ids.select(bucket_of(buckets=buckets).alias("b")).distinct().collect()]  # as many as entities named
        log = log.filter(F.col("bucket").isin(wanted)).filter(F.col("entity_id").isin(list(entities)))
    return merged(log, keys).drop("bucket")


def compact(spark: SparkSession, path: str, keys: Sequence[str], target: str, buckets: int = BUCKETS) -> int:
    """Write the merged table as one batch under `target`; it must have a row for each write key of the log."""
    append(read(spark, path, keys, buckets=buckets), target, 0, buckets)
    n = spark.read.parquet(target).count()
    if n != spark.read.option("basePath", path).parquet(path).select(*write_key(keys)).distinct().count():
        raise RuntimeError("the compacted table has another number of rows")
    return n


def relayout(source: DataFrame, target: str, existing: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Lay a table out anew by entity bucket, with what the target's table holds already; equal rows count once.

    The rows written must be as many as both sides' distinct rows; only then may the source be dropped."""
    rows = (source if existing is None else existing.unionByName(source, allowMissingColumns=True)).distinct()
    append(rows, target, 0, buckets)
    n = source.sparkSession.read.parquet(target).count()
    if n != rows.count():
        raise RuntimeError("the new layout has another number of rows")
    return n


def pointer_log(spark: SparkSession, root: str) -> DataFrame | None:
    """(at, action, version, undone) in order of writing, or nothing yet."""
    try:
        return spark.read.schema("at long, action string, version string, previous string").json(f"{root}/_versions")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def current(spark: SparkSession, root: str) -> str | None:
    """The version that the newest entry of the log points to."""
    log = pointer_log(spark, root)
    row = log.orderBy(F.desc("at")).first() if log is not None else None
    return row.version if row else None


def _point(spark: SparkSession, root: str, action: str, version: str | None, previous: str | None) -> None:
    log = pointer_log(spark, root)
    at = 1 + ((log.agg(F.max("at")).first()[0] or 0) if log is not None else 0)
    spark.createDataFrame([(at, action, version, previous)], "at long, action string, version string, previous string").coalesce(1).write.mode("append").json(f"{root}/_versions")


def promote(spark: SparkSession, root: str, version: str, gate=None, dry_run: bool = False) -> bool:
    """Make a staged version current if the gate passes on the staged data; a version that was promoted before is refused."""
    if gate is not None and not gate(f"{root}/{version}"):
        return False
    log = pointer_log(spark, root)
    if log is not None and log.filter((F.col("version") == version) & (F.col("action") == "promote")).count():
        raise ValueError(f"{version} was promoted before")
    if not dry_run:
        _point(spark, root, "promote", version, current(spark, root))
    return True


def undo(spark: SparkSession, root: str) -> str | None:
    """Point back to what was current before the last promotion that isn't undone; refuses if there was nothing."""
    log = pointer_log(spark, root)
    events = sorted(log.collect(), key=lambda r: r.at) if log is not None else []  # one row for each promotion or undo
    stack: list = []
    for e in events:
        stack.append(e) if e.action == "promote" else stack and stack.pop()
    if not stack or stack[-1].previous is None:
        raise ValueError("there is no earlier version")
    _point(spark, root, "undo", stack[-1].previous, stack[-1].version)
    return stack[-1].previous


def retained(versions: DataFrame, newest: int = 3, days: int = 30) -> DataFrame:
    """Of versions (modality, version, age_days), add whether retention keeps each: among the newest, or young."""
    place = F.row_number().over(Window.partitionBy("modality").orderBy("age_days", F.desc("version")))
    return versions.withColumn("kept", (place <= newest) | (F.col("age_days") < days))


def newer_than(df: DataFrame, watermarks: DataFrame, key: str, at: str) -> DataFrame:
    """Rows strictly newer than their key's watermark; all rows of keys without one."""
    w = watermarks.select(F.col(key), F.col("watermark").alias("__w"))
    return df.join(w, key, "left").filter(F.col("__w").isNull() | (F.col(at) > F.col("__w"))).drop("__w")


def advance(watermarks: DataFrame, loaded: DataFrame, key: str, at: str, ref: str) -> DataFrame:
    """Watermarks after a load: the newest of each key."""
    new = loaded.groupBy(key).agg(F.max(at).alias("watermark"), F.max_by(ref, F.struct(at, ref)).alias("last_ref"))
    return watermarks.select(key, "watermark", "last_ref").unionByName(new).groupBy(key).agg(F.max("watermark").alias("watermark"), F.max_by("last_ref", F.struct("watermark", "last_ref")).alias("last_ref"))


def archive(new: DataFrame, stored: DataFrame, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Bodies that are not stored yet (one for each hash), and a log row for every arrival with `was_new`.

    Of arrivals with the same body only the first is new, by `order` and then by a hash of the row; none is where the body is stored."""
    hashed = new.withColumn("sha1", F.sha1(F.col("body").cast("binary")))
    known = stored.select("sha1", F.lit(True).alias("__known")).dropDuplicates(["sha1"])
    w = Window.partitionBy("sha1").orderBy(*order, F.xxhash64(*new.columns))
    marked = hashed.join(known, "sha1", "left").withColumn("was_new", (F.row_number().over(w) == 1) & F.col("__known").isNull()).drop("__known")
    return marked.filter("was_new").drop("was_new"), marked.drop("body")


def merge_documents(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by (accession, document_name, sha256), the newer row of equals."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("accession", "document_name", "sha256").orderBy(F.desc("__new"))
    return both.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place", "__new")


def durations(events: DataFrame) -> DataFrame:
    """Start and end events joined by the parent's id: (event_id, name, seconds)."""
    end = events.filter("phase = 'end'").select(F.col("parent_id").alias("event_id"), F.col("at").alias("ended"))
    return events.filter("phase = 'start'").join(end, "event_id").select("event_id", "name", (F.col("ended").cast("double") - F.col("at").cast("double")).alias("seconds"))
