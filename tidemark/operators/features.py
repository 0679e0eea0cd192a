"""Training features: period-by-concept matrices, pairs of them, and statistics of vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import fiscal_order, signed_log
from tidemark.operators import pit


def matrix(state: DataFrame, by: Sequence[str], concepts: Sequence[str], periods: int) -> DataFrame:
    """For each `by` group of an as-of state: x (periods x concepts, oldest first, left-padded with zeros), mask, seq_len.

    Values are signed-log normalised; a period's missing concepts are zero.  The last `periods` periods are kept,
    that bound being the matrix's height, so groups stay small."""
    when = F.struct("fiscal_year", fiscal_order(F.col("fiscal_period")).alias("o"), "fiscal_period")
    wanted = state.filter(F.col("concept").isin(list(concepts)))
    latest = [F.max_by(F.when(F.col("concept") == c, F.col("value")), F.when(F.col("concept") == c, F.struct("availability_date", "effective_date", "source_ref"))).alias(f"__c{i}") for i, c in enumerate(concepts)]
    wide = wanted.groupBy(*by, when.alias("__when")).agg(*latest)
    age = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__when")))
    row = F.array(*(F.coalesce(signed_log(F.col(f"__c{i}")), F.lit(0.0)).cast("float") for i in range(len(concepts))))
    kept = wide.withColumn("__age", age).filter(F.col("__age") <= periods)
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__age")).alias("a"), row.alias("r")))), lambda s: s["r"])
    out = kept.groupBy(*by).agg(rows.alias("__rows"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), len(concepts))
    n = F.size("__rows")
    return out.select(*by, F.concat(F.array_repeat(zero, F.lit(periods) - n), F.col("__rows")).alias("x"), F.concat(F.array_repeat(F.lit(0), F.lit(periods) - n), F.array_repeat(F.lit(1), n)).alias("mask"), n.alias("seq_len"))


def shards(spine: DataFrame, facts: DataFrame, keys: Sequence[str], concepts: Sequence[str], periods: int) -> DataFrame:
    """Input and target matrices of the pairs of a spine; pairs without input go, those without target stay with nulls."""
    pairs = pit.training_pairs(spine, facts, keys, lambda states, by: matrix(states, by, concepts, periods))
    sides = [f"{side}_{c}" for side in ("input", "target") for c in ("x", "mask", "seq_len")]
    return pairs.select("entity_id", "t", "horizon_q", "target_t", *sides)


def collapse_statistics(vectors: DataFrame, floor: float = 1.0, eps: float = 1e-4) -> DataFrame:
    """One row: mean hinge of each dimension's deviation below `floor`, and the squared off-diagonal covariance over the dimensions.

    One pass adds up the products of dimensions in each task by matrix products of Arrow batches, so what is shuffled is
    dimensions squared for each task, however many vectors there are.  Null vectors count for nothing."""

    def run(batches):
        n, total, products = 0, 0.0, 0.0
        for batch in batches:
            lists = batch.column("embedding").drop_null()
            if len(lists):
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
                n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            d = len(total)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(products.ravel()), pa.array(total[i]), pa.array(total[j]), pa.array(np.full(d * d, n))], names=["i", "j", "xy", "sx", "sy", "n"])

    part = vectors.select("embedding").mapInArrow(run, "i bigint, j bigint, xy double, sx double, sy double, n bigint")
    sums = part.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("xy", "sx", "sy", "n")))
    cov = (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)
    var = F.col("xy") / F.col("n") - F.pow(F.col("sx") / F.col("n"), 2)
    hinge = F.greatest(F.lit(0.0), F.lit(floor) - F.sqrt(var + eps))
    diagonal = F.col("i") == F.col("j")
    return sums.agg(F.avg(F.when(diagonal, hinge)).alias("variance_hinge"), (F.sum(F.when(~diagonal, cov * cov)) / F.sum(F.when(diagonal, 1))).alias("covariance"))
