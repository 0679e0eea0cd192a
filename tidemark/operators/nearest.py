"""Exact nearest neighbours by angle: vectors in rings around pivots, cells ruled out by the triangle inequality."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import stored

#: Pivots, and rings around each: what is known of the cells is PIVOTS x RINGS boxes of PIVOTS intervals, 130 KB.
PIVOTS, RINGS = 32, 8
#: About so many vectors, and so many queries, of a cell meet in one group; queries of a group are multiplied in slices.
PART, SLICE = 4096, 256
#: A query first meets its nearest cells, until they hold this many vectors for each neighbour wanted.
FIRST = 16
#: Angles closer than this are not told apart by bounds.
SLACK = 1e-6


class Cells(NamedTuple):
    """Pivots, and of each cell: its number, the box of its angles to all pivots, its vectors, its smallest id."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    first: np.ndarray


def _usable(df: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """(id, embedding) of rows with an id and a vector of finite components, of the given size."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col("embedding").cast("array<double>")).filter(F.col("id").isNotNull() & finite)
    return rows if size is None else rows.filter(F.size("embedding") == size)


def _nonzero() -> Column:
    return F.exists("embedding", lambda x: x != 0)


def _units(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _cell_of(angles: np.ndarray) -> np.ndarray:
    """The nearest pivot and the ring around it."""
    near = angles.argmin(axis=1)
    ring = np.minimum(angles[np.arange(len(angles)), near] / (np.pi / 2) * RINGS, RINGS - 1).astype(np.int64)
    return near * RINGS + ring


def _summary(rows: DataFrame, pivots: np.ndarray) -> Cells:
    """The boxes of all vectors' cells, from one pass: tasks send PIVOTS x RINGS x PIVOTS rows each at most, as many come back."""
    size = pivots.shape[1]

    def run(batches):
        low, high = np.full((PIVOTS * RINGS, len(pivots)), np.inf), np.full((PIVOTS * RINGS, len(pivots)), -np.inf)
        n, first = np.zeros(PIVOTS * RINGS, np.int64), np.full(PIVOTS * RINGS, np.iinfo(np.int64).max)
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_units(batch.column("embedding"), size), pivots)
                cell = _cell_of(angles)
                np.minimum.at(low, cell, angles)
                np.maximum.at(high, cell, angles)
                np.add.at(n, cell, 1)
                np.minimum.at(first, cell, batch.column("id").to_numpy(zero_copy_only=False))
        cell, pivot = (a.ravel() for a in np.meshgrid(np.flatnonzero(n), np.arange(len(pivots)), indexing="ij"))
        columns = [cell, pivot, low[cell, pivot], high[cell, pivot], n[cell], first[cell]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "pivot", "low", "high", "n", "first"])

    part = rows.mapInArrow(run, "cell bigint, pivot bigint, low double, high double, n bigint, first bigint")
    boxes = part.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.min("first").alias("first"))
    got = boxes.toPandas().sort_values(["cell", "pivot"])  # PIVOTS x RINGS x PIVOTS rows at most, however many vectors
    shape = (-1, len(pivots))
    at = lambda c: got[c].to_numpy().reshape(shape)
    return Cells(pivots, at("cell")[:, 0], at("low"), at("high"), at("n")[:, 0], at("first")[:, 0])


def _ask(queries: DataFrame, cells: Cells, k: int, rest: bool) -> DataFrame:
    """(q, embedding, cell, n): the cells that each query meets, first the nearest ones, then what is left within `reach`.

    A cell is left out where its smallest id is not below the query's, or where some pivot's angles prove that all its
    vectors are farther than `reach`."""
    size = cells.pivots.shape[1]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                ids, x = piece.column("id").to_numpy(zero_copy_only=False), _units(piece.column("embedding"), size)
                a = _angles(x, cells.pivots)[:, None, :]
                bound = np.maximum(np.maximum(cells.low - a, a - cells.high).max(axis=2), 0)
                bound[~x.any(axis=1)] = 0  # a vector of length zero is alike to all
                bound[cells.first[None, :] >= ids[:, None]] = np.inf
                rank = np.argsort(bound, axis=1, kind="stable")
                held = np.cumsum(np.where(np.isfinite(np.take_along_axis(bound, rank, 1)), cells.n[rank], 0), axis=1)
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, rank, held - cells.n[rank] < FIRST * k, axis=1)
                early &= np.isfinite(bound)
                if rest:
                    reach = piece.column("reach").to_numpy(zero_copy_only=False)
                    wanted = ~early & np.isfinite(bound) & (bound <= reach[:, None] + SLACK)
                else:
                    wanted = early
                i, c = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), piece.column("embedding").take(pa.array(i)), pa.array(cells.cell[c]), pa.array(cells.n[c])], names=["q", "embedding", "cell", "n"])

    return queries.mapInArrow(run, "q bigint, embedding array<double>, cell bigint, n bigint")


def _parts(count: Column) -> Column:
    return F.ceil(count / PART).cast("int")


def _meet(asked: DataFrame, vectors: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(q, id, cosine): of each group of a cell's vectors and queries, the `k` best smaller ids of each query.

    Both sides of a cell are dealt by hash into parts of bounded expected size, and every part of one side is copied once
    for each part of the other, so neither a crowded cell nor one that all queries ask for is a task's alone."""
    size = cells.pivots.shape[1]

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                cell = _cell_of(_angles(_units(batch.column("embedding"), size), cells.pivots))
                yield pa.RecordBatch.from_arrays([*batch.select(["id", "embedding"]).columns, pa.array(cell)], names=["id", "embedding", "cell"])

    counts = asked.groupBy("cell").agg(_parts(F.count(F.lit(1))).alias("slots"), F.ceil(F.first("n") / PART).cast("int").alias("parts"))
    counts = F.broadcast(counts)  # one row for each cell, PIVOTS x RINGS at most
    held = vectors.mapInArrow(deal, "id bigint, embedding array<double>, cell bigint").join(counts, "cell")
    held = held.select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "id", "embedding")
    wanted = asked.join(counts, "cell")
    wanted = wanted.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("q"), "slots").cast("int").alias("slot"), "q", "embedding")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        q, qs = left.column("q").to_numpy(), _units(left.column("embedding").combine_chunks(), size) if left.num_rows else np.empty((0, size))
        v, vs = right.column("id").to_numpy(), _units(right.column("embedding").combine_chunks(), size) if right.num_rows else np.empty((0, size))
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]]
        for start in range(0, len(q) if len(v) else 0, SLICE):
            cosine = np.round(qs[start : start + SLICE] @ vs.T, 12)
            for one, row in zip(q[start : start + SLICE], cosine, strict=True):
                at = np.flatnonzero(v < one)
                if len(at) > k:
                    least = np.partition(row[at], len(at) - k)[len(at) - k]
                    at = at[row[at] >= least]
                at = at[np.lexsort((v[at], -row[at]))[:k]]
                found.append([np.full(len(at), one), v[at], row[at]])
        return pa.table({name: pa.array(np.concatenate(c)) for name, c in zip(("q", "id", "cosine"), zip(*found, strict=True), strict=True)})

    by = ["cell", "part", "slot"]
    return wanted.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(compare, "q bigint, id bigint, cosine double")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def nearest_earlier(queries: DataFrame, vectors: DataFrame, key: str, k: int, cut: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(q, key, cosine, place, compared): for each query its `k` nearest vectors with a smaller key, ties by key.

    The PIVOTS vectors with the smallest hashes of their keys are pivots; a cell is a ring around one.  Each query meets its
    nearest cells first; the angle of its k-th best there then rules out every cell whose box of angles to the pivots is
    farther, and the rest is compared.  All of it is exact: a query with fewer than `k` so far rules out nothing.  `compared`
    counts the vectors in the cells that it met.  `key` identifies a vector.  Null vectors, those with null or non-finite components and
    those of another length than the pivots' take no part; those of length zero are no neighbours, and as queries are at
    cosine 0 of all.  `cut` stores what is read twice."""
    empty = f"q bigint, {key} bigint, cosine double, place int, compared bigint"
    chosen = _usable(vectors, key).filter(_nonzero()).orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()  # PIVOTS rows
    if not chosen:
        return queries.sparkSession.createDataFrame([], empty)
    size = len(chosen[0]["embedding"])
    pivots = np.array([r["embedding"] for r in chosen if len(r["embedding"]) == size])
    pivots /= np.sqrt((pivots * pivots).sum(axis=1, keepdims=True))
    held, asking = _usable(vectors, key, size).filter(_nonzero()), _usable(queries, key, size)
    cells = _summary(held, pivots)
    near = _ask(asking, cells, k, rest=False)  # short maps over the queries, cheaper made again than stored
    seeds = cut(_best(_meet(near, held, cells, k), k))
    reach = seeds.filter(F.col("place") == k).select(F.col("q").alias("id"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine")))).alias("reach"))
    bounded = asking.join(reach, "id", "left").fillna(4.0, ["reach"])  # no angle is that wide
    far = _ask(bounded, cells, k, rest=True)
    best = _best(seeds.drop("place").unionByName(_meet(far, held, cells, k)), k)
    met = near.unionByName(far).groupBy("q").agg(F.sum("n").alias("compared"))
    return best.join(met, "q").select("q", F.col("id").alias(key), "cosine", "place", "compared")
