"""Folders for what a job writes on its way: one rule for all of the library's own jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir or Spark's own checkpoint folder; a temporary one if neither is set and the master is this machine."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    base = sc.getConf().get("spark.checkpoint.dir") or (own.get() if own.isDefined() else None)
    if not base:
        if not sc.master.startswith("local") or "cluster" in sc.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/job-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet and read it back: what reads it twice doesn't compute it twice, and lost executors lose nothing."""
    path = folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
