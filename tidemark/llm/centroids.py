"""Integer k-means with exact assignment, filtered by distances in a PCA-rotated space.

Vectors are integers, and so are centroids, distances and sums: results are the same on any cluster.  A rotation keeps
distances, so with the leading rotated coordinates p and the norm r of the rest, |v - c|^2 is at least
|p(v) - p(c)|^2 + (r(v) - r(c))^2.  Principal axes put most of the variance into few coordinates, which makes the bound
tight.  It needs no exact rotation: what floating point may add is taken off, and each centroid whose bound does not
exceed the best distance known is verified in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored, tidied

#: Components of a vector, leading coordinates of the filter, clusters, rounds.
DIMENSIONS, LEADING, CLUSTERS, ROUNDS = 64, 12, 8, 10
#: Integers are below this, so 64 squared differences fit a signed 64-bit integer.
LIMIT = 1 << 27
#: Share of the squared norms by which rounding may lift a bound; double arithmetic stays below a thousandth of it.
SLACK = 1e-9
#: Vectors compared at once.
ROWS = 1 << 14


def whole_vector(embedding: Column, n: int = DIMENSIONS) -> Column:
    """Whether a vector has exactly `n` components, none null or non-finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == n) & finite, F.lit(False))


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """The vectors that are whole, as `v`: floor(scale * x) of each component; other columns pass through."""
    kept = vectors.filter(whole_vector(F.col("embedding")))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    large = F.exists("v", lambda x: F.abs(x) >= F.lit(LIMIT))
    refused = F.raise_error(F.lit(f"a component is not below {LIMIT // scale}: its squared distances need more than 64 bits"))
    return kept.withColumn("v", scaled).withColumn("v", F.when(large, refused.cast("array<int>")).otherwise(F.col("v").cast("array<int>"))).drop("embedding")


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def totals(df: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray]) -> dict[tuple[int, int], int]:
    """Sums of integer tables over all rows: one table a task, added exactly by Spark; as many cells as the table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                cells = work(batch.slice(start, ROWS)).astype(object)  # Python's integers don't overflow
                total = cells if total is None else total + cells
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(map(str, total.ravel()), pa.string())], names=["i", "j", "n"])

    cells = df.mapInArrow(tidied(run), "i int, j int, n string")
    added = cells.groupBy("i", "j").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    return {(r.i, r.j): int(r.n) for r in added}


def principal_axes(vectors: DataFrame) -> np.ndarray:
    """The principal axes of all vectors, largest variance first, as columns; any basis would keep the bound right."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        v = matrix(batch.column("v"), np.int64)
        row = np.hstack([np.ones((len(v), 1), np.int64), v])
        # a product of two components has up to 54 bits, and 2**14 rows are added: one factor is split in halves
        return (row.T @ (row >> 14)).astype(object) * (1 << 14) + row.T @ (row & 0x3FFF)

    found = totals(vectors.select("v"), moments)
    if not found:
        return np.eye(DIMENSIONS)
    size = 1 + max(j for _, j in found)
    moment = np.array([[found[i, j] / found[0, 0] for j in range(size)] for i in range(size)])
    return np.linalg.eigh(moment[1:, 1:] - np.outer(moment[0, 1:], moment[0, 1:]))[1][:, ::-1]


def rotated(v: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading rotated coordinates, the norm of the rest, and the squared norm."""
    turned = v.astype(np.float64) @ axes
    return turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(1)), (v.astype(np.float64) ** 2).sum(1)


def with_rotation(vectors: DataFrame, axes: np.ndarray, leading: int) -> DataFrame:
    """Add `p`, the leading rotated coordinates, and `r`, the norm of the rest."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    added = [pa.field("p", pa.list_(pa.float64())), pa.field("r", pa.float64())]
    schema = pa.schema([*to_arrow_schema(vectors.schema), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, r, _ = rotated(matrix(batch.column("v"), np.int64).reshape(-1, len(axes)), axes, leading)
            ends = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(p.ravel())), pa.array(r)], schema=schema)

    return vectors.mapInArrow(tidied(run), from_arrow_schema(schema))


class Nearest:
    """The nearest of some centroids, exactly; of equally near ones the one with the smallest number."""

    def __init__(self, centroids: np.ndarray, axes: np.ndarray, leading: int):
        self.centroids = centroids
        self.p, self.r, self.norm = rotated(centroids, axes, leading)

    def exact(self, v: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return ((v - self.centroids[chosen]) ** 2).sum(1)

    def find(self, v: np.ndarray, p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, squared distances, and how many centroids were verified, for each vector."""
        norm = (p**2).sum(1) + r**2
        bound = np.stack([((p - q) ** 2).sum(1) + (r - s) ** 2 - SLACK * (norm + size + 1) for q, s, size in zip(self.p, self.r, self.norm, strict=True)], 1)
        best = bound.argmin(1)
        first, distance, verified = best.copy(), self.exact(v, best), np.ones(len(v), np.int32)
        for c in range(len(self.centroids)):
            left = np.flatnonzero((bound[:, c] <= distance) & (first != c))
            d = self.exact(v[left], np.full(len(left), c))
            verified[left] += 1
            nearer = (d < distance[left]) | ((d == distance[left]) & (c < best[left]))
            best[left[nearer]], distance[left[nearer]] = c, d[nearer]
        return best, distance, verified

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = batch.num_rows
        v, p = matrix(batch.column("v"), np.int64), matrix(batch.column("p"), np.float64)
        return self.find(v, p.reshape(n, -1), batch.column("r").to_numpy(zero_copy_only=False))


def seeds(vectors: DataFrame, k: int, salt: int) -> np.ndarray:
    """The `k` vectors with the smallest hash of salt and vec_id, in ascending order; of one id, the smaller vector."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    picked = vectors.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in picked], np.int64).reshape(len(picked), DIMENSIONS)


def lloyd(vectors: DataFrame, axes: np.ndarray, centroids: np.ndarray, rounds: int, leading: int = LEADING) -> np.ndarray:
    """The centroids after some rounds; rounds that would change nothing more are left out."""
    for _ in range(rounds):
        nearest = Nearest(centroids, axes, leading)

        def sums(batch: pa.RecordBatch, nearest: Nearest = nearest) -> np.ndarray:
            v, best = matrix(batch.column("v"), np.int64), nearest.of(batch)[0]
            out = np.zeros((len(nearest.centroids), v.shape[1] + 1), np.int64)
            for c in range(len(out)):
                out[c, 0], out[c, 1:] = (best == c).sum(), v[best == c].sum(0)
            return out

        found = totals(vectors.select("v", "p", "r"), sums)
        moved = centroids.copy()
        for c in range(len(centroids)):
            if found[c, 0]:
                moved[c] = [found[c, j + 1] // found[c, 0] for j in range(centroids.shape[1])]
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def assign(vectors: DataFrame, axes: np.ndarray, centroids: np.ndarray, leading: int = LEADING) -> DataFrame:
    """Add `cluster`, `distance` (squared) and `verified`, how many centroids were compared in integers."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    kept = [c for c in vectors.columns if c not in ("v", "p", "r")]
    schema = pa.schema([*to_arrow_schema(vectors.select(*kept).schema), ("cluster", pa.int32()), ("distance", pa.int64()), ("verified", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, axes, leading)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                best, distance, verified = nearest.of(batch)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.int32()), pa.array(distance, pa.int64()), pa.array(verified)], schema=schema)

    return vectors.mapInArrow(tidied(run), from_arrow_schema(schema))


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: int = 3, leading: int = LEADING) -> tuple[DataFrame, np.ndarray]:
    """Every whole vector with `cluster`, squared `distance` and `verified`; the centroids.

    Needs vec_id and embedding; other columns are left out, whatever their names.  Vectors with another number of
    components, nulls or non-finite components are not clustered; null ids never seed before others, equal rows stay as
    many, and with fewer vectors than `k` there are as many centroids as vectors.  A component of LIMIT / 1024 or more
    is an error, since distances are 64-bit integers.  An empty table gives no rows.  The driver holds `k` centroids and
    the second moments, whose sizes follow from the dimensions alone; each round reads the stored vectors once and
    shuffles one small table a task.
    """
    whole = stored(integers(vectors.select("vec_id", "embedding")), "integers")
    axes = principal_axes(whole)
    turned = stored(with_rotation(whole, axes, leading), "rotated")
    centroids = seeds(whole, k, salt)
    discard(whole)
    if not len(centroids):  # no vector is whole
        return turned.selectExpr("vec_id", "0 cluster", "0L distance", "0 verified"), centroids
    centroids = lloyd(turned, axes, centroids, rounds, leading)
    return assign(turned, axes, centroids, leading), centroids


def op13(vectors: DataFrame) -> DataFrame:
    """Clusters of the embeddings, with inertias and the digest of each final centroid (as many rows as centroids)."""
    found, centroids = cluster(vectors)
    found = stored(found.drop("verified"), "assigned")
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    every = sum(inertia.values())
    rows = [(c, inertia.get(c, 0), every, digest) for c, digest in enumerate(digests)]
    of_cluster = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return found.join(F.broadcast(of_cluster), "cluster").select(*columns)


@lru_cache(1)
def oracle_sql() -> str:
    """DuckDB SQL for `op13`: ten rounds written out."""
    nearest = """select id, vec_id, v, c.cluster, list_sum(list_transform(list_zip(v, c.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint distance
  from kept cross join {centres} c qualify row_number() over (partition by id order by distance, c.cluster) = 1"""
    parts = [
        f"""kept as materialized (select row_number() over () id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS})""",
        f"""c0 as materialized (select (row_number() over (order by h, v) - 1)::int cluster, v centre from (select sha256('3:' || vec_id) h, v from kept)
  order by h, v limit {CLUSTERS})""",
    ]
    for i in range(ROUNDS):
        parts += [
            f"a{i} as materialized ({nearest.format(centres=f'c{i}')})",
            f"u{i} as (select cluster, unnest(v) x, generate_subscripts(v, 1) p from a{i})",
            f"s{i} as (select cluster, p, sum(x)::hugeint s, count(*)::hugeint n from u{i} group by all)",
            f"m{i} as (select cluster, list((((s - ((s % n) + n) % n) // n))::bigint order by p) centre from s{i} group by 1)",
            f"c{i + 1} as materialized (select c.cluster, coalesce(m.centre, c.centre) centre from c{i} c left join m{i} m using (cluster))",
        ]
    return f"""with {", ".join(parts)},
f as materialized ({nearest.format(centres=f"c{ROUNDS}")})
select vec_id, f.cluster, distance, (sum(distance) over (partition by f.cluster))::bigint cluster_inertia, (sum(distance) over ())::bigint inertia,
  sha256(array_to_string(centre, ',')) centroid_sha256 from f join c{ROUNDS} c on c.cluster = f.cluster"""
