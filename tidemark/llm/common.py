"""Helpers that the corpus operators share: reading tables, stored intermediates, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an Arrow function handles at once; larger incoming batches are cut into slices.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset and the master is this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not found:
        if not (sc.master.startswith("local") and "cluster" not in sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: later jobs start from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what `stored` wrote, once no later plan reads it."""
    spark, path = df.sparkSession, getattr(df, "_stored_at", None)
    if path:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about `limit` bytes of `column` at most, and one row at least."""
    if batch.column(batch.schema.get_field_index(column)).nbytes <= limit:
        yield batch
    elif batch.num_rows == 1:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), column, limit)
        yield from slices(batch.slice(half), column, limit)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that, at the end of its task, hands freed memory back: workers live on, and idle ones would hold on to it."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return inner


def map_batches(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], list]], added: list[pa.Field], keep: list[str] | None = None, reads: tuple[str, ...] = (), limit: int = SLICE_BYTES) -> DataFrame:
    """Add columns computed from Arrow batches.

    `make` runs once in each task and returns the function that maps a batch to a list of arrays, one for each
    field in `added`.  Batches are cut by the size of `column`, so memory does not follow the row count.  Added
    columns replace columns of the same name (compared as Spark does, without case).  `keep` names the columns
    that pass through, all of them by default; `reads` names others that
    `make` needs; `limit` replaces SLICE_BYTES.
    """
    fresh = {f.name.lower() for f in added}
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in fresh]
    source = df.select(*{c: F.col(f"`{c}`") for c in dict.fromkeys([*kept, column, *reads])}.values())
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    schema = pa.schema([*(to_arrow_schema(source.select(*(F.col(f"`{c}`") for c in kept)).schema) if kept else []), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole, column, limit):
                if batch.num_rows:
                    arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept] + work(batch)
                    yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in added)])

    return source.mapInArrow(tidied(run), from_arrow_schema(schema))
