"""The seeded order: a permutation of any size, the same for any layout, each shard alone."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import order


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 101, 1000, 4099])
def test_every_size_is_permuted_and_undone(spark, n):
    rows = spark.range(n).withColumn("p", order.place_of(F.col("id"), F.lit(n).cast("bigint"), 5)).withColumn("back", order.row_at(F.col("p"), F.lit(n).cast("bigint"), 5)).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_huge_counts_do_not_overflow(spark):
    n = (1 << 47) - 5
    df = spark.createDataFrame([(0,), (n // 3,), (n - 1,)], "id long").withColumn("p", order.place_of(F.col("id"), F.lit(n), 9))
    rows = df.withColumn("back", order.row_at(F.col("p"), F.lit(n), 9)).collect()
    assert all(0 <= r.p < n and r.back == r.id for r in rows) and len({r.p for r in rows}) == 3


def test_places_look_random(spark):
    n = 2000
    p = [r.p for r in spark.range(n).select("id", order.place_of(F.col("id"), F.lit(n).cast("bigint"), 1).alias("p")).orderBy("id").collect()]
    mean = (n - 1) / 2
    variance = sum((x - mean) ** 2 for x in p) / n
    serial = sum((a - mean) * (b - mean) for a, b in zip(p, p[1:], strict=False)) / n / variance
    assert abs(serial) < 0.1
    fixed = sum(i == x for i, x in enumerate(p))
    assert fixed < 12


def test_places_and_shards_for_any_layout(spark):
    df = spark.range(503).selectExpr("id", "cast(id % 7 as string) as kind", "id * 2 as extra")
    one, two = ({r.id: r.place for r in order.places(df.repartition(k), 3, "id", "kind").collect()} for k in (1, 6))
    assert one == two and sorted(one.values()) == list(range(503))
    assert one != {r.id: r.place for r in order.places(df, 4, "id", "kind").collect()}
    shards = [order.shard(df, 3, i, 4, "id", "kind").collect() for i in range(4)]
    assert [len(s) for s in shards] == [125, 126, 126, 126]
    assert {r.id: r.place for s in shards for r in s} == one


def test_no_global_sort_and_odd_inputs(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "id long, kind string")
    got = order.places(df, 3, "id", "kind").collect()
    assert sorted(r.place for r in got) == [0, 1, 2, 3]
    assert order.places(df.limit(0), 3, "id").collect() == []
    plan = order.places(spark.range(100), 3, "id")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Cartesian" not in plan
