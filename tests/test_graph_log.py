"""A log of quarterly changes gives the graph of any quarter, from fewer rows than its snapshots."""

import random
from datetime import date, timedelta

from tidemark.operators import graph_log, pit

SCHEMA = "entity_id string, target_entity_id string, relationship_type string, availability_date date, restated_at date, effective_date date, source_ref string"
ENDS = [date(y, m, d) for y in (2020, 2021, 2022) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))][:10]


def relations(spark, n=600, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        day = date(2019, 10, 1) + timedelta(r.randrange(1000))
        gone = day + timedelta(r.randrange(0, 400)) if r.random() < 0.4 else None
        rows.append((f"a{r.randrange(12)}" if r.random() < 0.95 else None, f"b{r.randrange(12)}", r.choice("xy"), day, gone, day, f"{i:05d}"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def build(df, path):
    for since, t in zip([None, *ENDS], ENDS, strict=False):
        graph_log.append_quarter(df, path, since, t)


def rows_of(df):
    return sorted(map(tuple, df.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()), key=repr)


def test_every_quarter_equals_the_full_view(spark, tmp_path):
    df, path = relations(spark).cache(), str(tmp_path / "log")
    build(df, path)
    for t in ENDS:
        assert rows_of(graph_log.snapshot(spark, path, t)) == rows_of(pit.as_of(df, t, graph_log.RELATION))
    graph_log.append_quarter(df, path, ENDS[3], ENDS[4])  # a quarter written again changes nothing
    assert rows_of(graph_log.snapshot(spark, path, ENDS[-1])) == rows_of(pit.as_of(df, ENDS[-1], graph_log.RELATION))


def test_the_log_is_smaller_than_snapshots(spark, tmp_path):
    day = date(2020, 1, 5)
    steady = [(f"a{i}", f"b{i % 7}", "x", day, None, day, f"{i:05d}") for i in range(2000)]
    late = [(f"a{i}", "c", "x", ENDS[5], None, ENDS[5], f"{i:05d}") for i in range(50)]
    df, path = spark.createDataFrame(steady + late, SCHEMA), str(tmp_path / "log")
    build(df, path)
    written = spark.read.parquet(path).count()
    assert written == 2050
    assert sum(graph_log.snapshot(spark, path, t).count() for t in ENDS) == 20000 + 5 * 50


def test_snapshots_read_only_their_quarters(spark, tmp_path):
    path = str(tmp_path / "log")
    build(relations(spark, 50), path)
    plan = graph_log.snapshot(spark, path, ENDS[2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quarter" in plan
    build(relations(spark, 50).limit(0), str(tmp_path / "none"))
    assert graph_log.snapshot(spark, str(tmp_path / "none"), ENDS[2]).collect() == []
