"""A manifest of a table's files: which entities each can hold, by smallest and largest id and a Bloom filter.

A scan of named entities reads the manifest before it lists anything, and then only the files that can hold them.  The
manifest of a batch is written after its files; batches without one are read by their buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import tables

#: Bits of a filter, which is the size of Spark's bitmaps, and hashes of an id: 3,000 ids let one in 600 others through.
BITS, HASHES = 32768, 4

SCHEMA = "file string, low string, high string, n long, filter binary, batch long"


def _positions(entity: str | Column) -> Column:
    """The bits of an id."""
    return F.array(*(F.pmod(F.xxhash64(entity, F.lit(i)), F.lit(BITS)).cast("int") for i in range(HASHES)))


def index_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Write the manifest of a batch that `tables.append` wrote; done again, it replaces itself.  Only ids are read."""
    at = f"{path}/batch={batch_id:012d}"
    ids = spark.read.parquet(at).filter("entity_id is not null").select(F.input_file_name().alias("file"), "entity_id")
    spans = ids.groupBy("file").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high"), F.count("*").alias("n"))
    bits = ids.distinct().select("file", F.explode(_positions("entity_id")).alias("bit")).groupBy("file").agg(F.bitmap_construct_agg("bit").alias("filter"))
    rows = spans.join(bits, "file").select("file", "low", "high", "n", "filter")
    rows.write.mode("overwrite").parquet(f"{path}/_files/batch={batch_id:012d}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """One row for each file of the indexed batches, or nothing where none is indexed."""
    try:
        return spark.read.schema(SCHEMA).option("basePath", f"{path}/_files").parquet(f"{path}/_files")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def files_of(manifest: DataFrame, entities: Sequence[str]) -> list[str]:
    """The files that can hold any of the entities: all that do, and few others; as many as named entities have batches."""
    wanted = manifest.sparkSession.createDataFrame([(e,) for e in entities], "entity_id string")
    asked = wanted.select("entity_id", _positions("entity_id").alias("bits"))
    # an id's bit is looked up in the byte of the bitmap that holds it
    byte = lambda bit: F.conv(F.hex(F.substring(F.col("filter"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.forall("bits", lambda bit: byte(bit).bitwiseAND(F.call_function("shiftleft", F.lit(1), bit % 8)) != 0)
    near = manifest.join(F.broadcast(asked), F.col("entity_id").between(F.col("low"), F.col("high")))  # the named entities are a literal list
    return sorted(r.file for r in near.filter(held).select("file").distinct().collect())


def read_entities(spark: SparkSession, path: str, keys: Sequence[str], entities: Sequence[str], buckets: int = tables.BUCKETS) -> tuple[DataFrame, list[str]]:
    """The merged rows of named entities, and the indexed files that are read for them.

    A write key belongs to one entity, so rows of other entities never decide.  Entities that no file holds give an empty
    frame with the table's columns."""
    everything = spark.read.option("basePath", path)
    manifest = read_manifest(spark, path)
    whole = everything.parquet(path)
    if manifest is None:
        return tables.read(spark, path, keys, entities, buckets), []
    files = files_of(manifest, entities)
    indexed = [r.batch for r in manifest.select("batch").distinct().collect()]
    late = whole.filter(~F.col("batch").isin(indexed))
    log = everything.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    ids = spark.createDataFrame([(e,) for e in entities], "entity_id string")
    in_buckets = [r.b for r in ids.select(tables.bucket_of(buckets=buckets).alias("b")).distinct().collect()]
    log = log.unionByName(late.filter(F.col("bucket").isin(in_buckets)))
    return tables.merged(log.filter(F.col("entity_id").isin(list(entities))), keys).drop("bucket"), files
