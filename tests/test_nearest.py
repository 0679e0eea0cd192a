"""Nearest earlier vectors against all pairs."""

import numpy as np
import pytest

from tidemark.operators import nearest

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, x, more=()):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + list(more), SCHEMA).repartition(4)


def brute(x, q, k):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    others = [i for i in range(q) if norm[i] > 0]
    return sorted(others, key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:k]


def check(spark, x, step, k, more=()):
    df = frame(spark, x, more)
    rows = nearest.nearest_earlier(df.filter(f"vec_id % {step} = 0"), df, "vec_id", k).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.place):
        got.setdefault(r.q, []).append(r.vec_id)
    want = {q: brute(x, q, k) for q in range(0, len(x), step)}
    assert got == {q: v for q, v in want.items() if v}
    return rows


def test_odd_vectors_against_all_pairs(spark):
    x = np.float32(np.random.default_rng(4).normal(size=(300, 5)).round(1)).astype(float)
    x[7] = x[150] = 0
    x[20:40] = x[3]
    check(spark, x, 50, 3, [(None, [1.0] * 5), (900, None), (901, [1.0, float("nan"), 0.0, 0.0, 0.0]), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [1.0])])


def test_clusters_are_pruned_and_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.float32(rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)] + 0.05 * rng.normal(size=(3000, 16))).astype(float)
    monkeypatch.setattr(nearest, "PART", 64)  # crowded cells go to many groups
    rows = check(spark, x, 25, 5)
    share = sum(r.compared for r in rows if r.place == 1) / sum(r.q for r in rows if r.place == 1)
    assert share < 0.5


def test_plan_and_empty_tables(spark):
    x = np.random.default_rng(6).normal(size=(60, 4))
    df = frame(spark, x)
    plan = nearest.nearest_earlier(df, df, "vec_id", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    none = df.limit(0)
    assert nearest.nearest_earlier(df, none, "vec_id", 2).collect() == [] == nearest.nearest_earlier(none, df, "vec_id", 2).collect()


@pytest.mark.parametrize("k", [1, 80])
def test_fewer_neighbours_than_wanted(spark, k):
    check(spark, np.float32(np.random.default_rng(7).normal(size=(40, 3))).astype(float), 3, k)
