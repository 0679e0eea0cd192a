"""Connected components by DataFrame joins: alternating large-star and small-star steps.

Each step keeps the components and brings every edge closer to its component's smallest node; minima are combined
on the map side and joined back on the node, those of nodes with very many neighbours by broadcast, so no node's edges
are one task's group.  Edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored


#: A key of more than HOT_ROWS rows, and of more than one row in HOT_KEYS of its table, is hot: there are HOT_KEYS of them at most.
HOT_ROWS, HOT_KEYS = 256, 4096
#: Rows of a table that one task can join, whatever its keys: up to here hot keys need no plan of their own.
FEW_ROWS = 200_000


def _hot(counts: DataFrame, key: str, rows: int) -> DataFrame:
    """The hot keys of a table of `rows` rows, by the rows `c` of each: a bounded list, so it is broadcast."""
    return F.broadcast(counts.filter(F.col("c") > max(HOT_ROWS, rows // HOT_KEYS)).select(key))


def join_unique(big: DataFrame, small: DataFrame, key: str, counts: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Left join of `big`, in which a key may hold any share of the rows, with `small`, in which it is unique.

    What `small` has of hot keys is broadcast, so their rows stay where they are; the rest is shuffled.  `counts` (key, c)
    are the rows of each key in `big` or more, `rows` those of `big`.  A table of FEW_ROWS rows is joined as it is: a search
    for components is many rounds, and the plans of all of them are held by the driver."""
    rows = big.count() if rows is None else rows
    if rows <= FEW_ROWS:
        return big.join(small, key, "left")
    hot = _hot(big.groupBy(key).agg(F.count(F.lit(1)).alias("c")) if counts is None else counts, key, rows)
    at_hot = big.join(hot, key, "left_semi").join(F.broadcast(small.join(hot, key, "left_semi")), key, "left")
    return at_hot.unionByName(big.join(hot, key, "left_anti").join(small, key, "left"))


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """edges: (u, v) with u > v.  large: hang the larger neighbours of each node on its smallest; else the smaller ones and itself."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        # (v, m(u)) for each neighbour v above u; here `v` is the upper end
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("to"))
        out = join_unique(up, least.select("u", "m"), "u", least, rows).select(F.col("to").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        out = join_unique(edges, least.select("u", "m"), "u", least, rows).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge that joins two: the component's smallest node.

    `edges` has two columns of one orderable type.  Nulls and loops count as no edge, repeated edges as one; no
    edges give no rows.
    """
    a, b = edges.columns
    edges = edges.select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).filter("a <> b")
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        mark = seen
        after = stored(_star(_star(now, True, seen[0]), False, seen[0]), "edges")
        discard(now)
        now = after
