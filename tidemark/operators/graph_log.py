"""A temporal graph as a log of changes by quarter: a new quarter appends what changed, a snapshot reads a range of quarters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import pit

RELATION = ["entity_id", "target_entity_id", "relationship_type"]


def _label(t) -> str:
    return f"{t:%Y%m%d}"


def changes(relations: DataFrame, since, t, keys: Sequence[str] = RELATION) -> DataFrame:
    """(relations' columns, closed): relations whose state at `t` may differ from that at `since` (None: before the first).

    Only relations of which a version came or was withdrawn after `since` are looked at.  One with a version that stands at
    `t` has its newest as a row; one with none is a closing row of its keys, with nulls elsewhere."""
    t = F.lit(t).cast("date")
    known = relations.filter(F.col("availability_date") <= t)
    if since is not None:
        after = F.lit(since).cast("date")
        moved = known.filter((F.col("availability_date") > after) | ((F.col("restated_at") > after) & (F.col("restated_at") <= t)))
        touched = moved.select(*(F.col(c).alias(f"__{c}") for c in keys)).distinct()
        known = known.join(touched, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left_semi")
    # a standing version comes before every withdrawn one
    best = F.struct(pit.visible(t).alias("stands"), "availability_date", "source_ref", F.struct(*relations.columns).alias("row"))
    won = known.groupBy(*keys).agg(F.max(best).alias("b"))
    columns = [F.col(c) if c in keys else F.when(F.col("b.stands"), F.col(f"b.row.{c}")).alias(c) for c in relations.columns]
    return won.select(*columns, (~F.col("b.stands")).alias("closed"))


def append_quarter(relations: DataFrame, path: str, since, t, keys: Sequence[str] = RELATION) -> None:
    """Write the changes of (since, t] as a folder of their own; the same quarter again replaces itself and nothing else.

    A first quarter (`since` None) has no closing rows: nothing is open before it."""
    rows = changes(relations, since, t, keys)
    (rows if since is not None else rows.filter("not closed")).write.mode("overwrite").parquet(f"{path}/quarter={_label(t)}")


def snapshot(spark: SparkSession, path: str, t, keys: Sequence[str] = RELATION) -> DataFrame:
    """The graph at a quarter end of the log: the last change of each relation up to it, unless that closed it."""
    log = spark.read.option("basePath", path).parquet(path).filter(F.col("quarter") <= int(_label(t)))
    columns = [c for c in log.columns if c not in ("quarter", "closed")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct("closed", *columns), "quarter").alias("r"))
    return last.filter("not r.closed").select(*(F.col(f"r.{c}").alias(c) for c in columns))
