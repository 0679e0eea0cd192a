"""The findings on shuffles, memory of a task and Python's memory."""

from datetime import date

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import pit, text
from tidemark.plans import catalog, views

SCHEMA = "entity_id string, concept string, availability_date date, restated_at date, source_ref string, value double"
day = st.integers(0, 40).map(lambda n: date.fromordinal(738000 + n))
version = st.tuples(st.integers(0, 2), st.sampled_from(["c", None]), st.one_of(st.none(), day), st.one_of(st.none(), day), st.integers(0, 5))


def rows_moved(df):
    """Scans of lineitem and shuffles in the plan."""
    plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
    return plan[0].count("lineitem.parquet"), plan[1].count("Exchange hashpartitioning")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(version, max_size=25), st.lists(day, min_size=1, max_size=4, unique=True))
def test_states_at_a_list_of_dates_equal_the_spine_join(spark, history, days):
    df = spark.createDataFrame([(f"e{e}", c, a, r, f"R{ref}-{i}", float(i)) for i, (e, c, a, r, ref) in enumerate(history)], SCHEMA)
    times = spark.createDataFrame([(d,) for d in days], "t date")
    spine = spark.createDataFrame([(f"e{e}", d) for e in range(3) for d in days], "entity_id string, t date")
    want, plain, cut = (sorted((r.entity_id, r.t, r.value) for r in x.collect()) for x in (
        pit.as_of_join(spine, df, ["concept"]), pit.as_of_dates(df, times, ["concept"]), pit.as_of_dates(df, times, ["concept"], cut_months=1)))
    assert plain == cut == want


@pytest.mark.parametrize(("name", "shuffles"), [("pit_05", 3), ("jn_06", 5), ("pit_07", 4)])
def test_states_of_all_entities_join_lines_once_and_look_up_no_entity(spark, data, name, shuffles):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_moved(catalog.queries()[name](spark, data)) == (1, shuffles)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_summarise_each_date_once(spark):
    """A date that is also a target date is summarised once; both kinds of spines give the same pairs."""
    df = spark.createDataFrame([("a", "c", date(2020, 1, 1), None, "r1", 1.0), ("a", "d", date(2021, 1, 5), None, "r2", 2.0), ("b", "c", date(2021, 6, 1), date(2021, 7, 1), "r3", 3.0)], SCHEMA)
    times = spark.createDataFrame([(date(2020, 12, 31),), (date(2021, 12, 31),)], "t date")
    seen = []

    def keep(known):
        seen.append(known.select("entity_id", "__d").collect())
        return known

    count = lambda states, by: states.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    whole = pit.build_spine(df.select("entity_id").distinct(), times, [4])
    for spine in (pit.build_pairs(times, [4]), whole):
        pairs = pit.training_pairs(spine, df, ["concept"], count, keep)
        assert sorted((r.entity_id, r.t, r.horizon_q, r.target_t, r.input_n, r.target_n) for r in pairs.collect()) == [
            ("a", date(2020, 12, 31), 4, date(2021, 12, 31), 1, 2), ("a", date(2021, 12, 31), 4, date(2022, 12, 31), 2, 2)]
    assert [len(x) for x in seen] == [3, 3]


@pytest.mark.parametrize(("name", "shuffles"), [("prj_01", 4), ("grf_04", 6)])
def test_relations_are_told_apart_within_their_orders(spark, data, name, shuffles):
    """The sort by order that finds repeated relations serves the join with orders: no table of whole relations in a task, no shuffle of them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()[name](spark, data)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert rows_moved(df) == (1, shuffles)
        assert name != "prj_01" or "Aggregate" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_odd_relations_are_each_kept_once(spark, tmp_path):
    """Repeated lines and orders, nulls, an order without lines and lines without order or part."""
    lines = spark.createDataFrame([(1, 1, 5), (1, 1, 5), (1, 2, 5), (1, 3, 5), (1, 1, None), (1, 1, None), (2, 1, 6), (None, 1, 5), (9, 1, 5), (1, 99, 5)], "l_orderkey long, l_partkey long, l_suppkey long")
    orders = spark.createDataFrame([(1, 7, "2020-02-03 00:00:00"), (1, 7, "2020-02-03 00:00:00"), (1, 8, "2020-02-03 00:00:00"), (2, None, None), (3, 1, "2020-01-01 00:00:00"), (None, 1, None)], "o_orderkey long, o_custkey long, d string")
    parts = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "p_partkey long, p_type string")
    for name, df in (("lineitem", lines), ("orders", orders.select("o_orderkey", "o_custkey", F.col("d").cast("timestamp").alias("o_orderdate"))), ("part", parts)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    s, c = "us-cik-000000000{}".format, date(2020, 2, 3)
    want = [(e, s(k), kind, c, date(2020, 1, 1), "1") for k in (7, 8) for e, kind in ((s(5), "x"), (s(5), None), (None, "x"))] + [(s(6), None, "x", None, None, "2")]
    columns = ["entity_id", "target_entity_id", "relationship_type", "availability_date", "effective_date", "source_ref"]
    got = views.edges(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_pages_become_text_in_slices_of_bounded_size(spark):
    pages = [None, "", "<p>a</p><p>b</p>", "<script>x</script>", "x" * 3000] * 50
    parts = list(text.slices(pa.array(pages, pa.string()), 10_000))
    assert sum(map(len, parts)) == len(pages) and all(p.nbytes <= 10_000 for p in parts)
    assert [len(p) for p in text.slices(pa.array(["y" * 50] * 2, pa.string()), 10)] == [1, 1]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string").repartition(3)
    got = {r.id: r.text for r in df.select("id", text.html_to_text(F.col("html")).alias("text")).collect()}
    assert got == {i: text.plain_text(p) for i, p in enumerate(pages)}
