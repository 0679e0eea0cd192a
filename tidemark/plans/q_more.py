"""Queries of table layouts, remaining filters, projections and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators import pit, quality, resolve
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views import EDGES, FACT_KEYS, FACTS, STATEMENTS, table
from tidemark.sources import schemas, scratch, tables

_TOTALS = f"select concept, count(*) as n, round(sum(value), 2) as total from {FACTS} group by 1"


def _totals(df):
    return df.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("src_03", _TOTALS)
def src_03(spark, sf_dir):
    """A table written and read back."""
    path = scratch.folder(spark, "facts")
    views.facts(spark, sf_dir).write.parquet(path)
    return _totals(spark.read.parquet(path))


@query("src_23", _TOTALS)
def src_23(spark, sf_dir):
    """A table re-laid by entity bucket, equal rows once, the row count checked."""
    source, target = scratch.folder(spark, "facts"), scratch.folder(spark, "buckets")
    views.facts(spark, sf_dir).write.parquet(source)
    tables.relayout(spark.read.parquet(source), target, buckets=8)
    return _totals(spark.read.parquet(target))


@query("dq_16", _TOTALS)
def dq_16(spark, sf_dir):
    """The same batches written twice leave the table as it was."""
    path, f = scratch.folder(spark, "twice"), views.facts(spark, sf_dir)
    f = scratch.stored(f)  # three appends read it
    for batch in (1, 2, 2):
        tables.append(f, path, batch, 8)
    return _totals(tables.read(spark, path, FACT_KEYS, buckets=8))


@query("ver_01", "select 'v2' as current, count(*) as n from lineitem where l_returnflag = 'R'")
def ver_01(spark, sf_dir):
    """A staged version promoted after a gate on its own data; reading goes by the pointer."""
    root, l = scratch.folder(spark, "root"), table(spark, sf_dir, "lineitem")
    for version, flag in (("v1", "A"), ("v2", "R")):
        l.filter(F.col("l_returnflag") == flag).write.parquet(f"{root}/{version}")
        tables.promote(spark, root, version, gate=lambda path: not spark.read.parquet(path).isEmpty())
    now = tables.current(spark, root)
    return spark.read.parquet(f"{root}/{now}").agg(F.lit(now).alias("current"), F.count(F.lit(1)).alias("n"))


@query("ver_02", "select 'v1' as current, count(*) as n from lineitem where l_returnflag = 'A'")
def ver_02(spark, sf_dir):
    """The last promotion undone."""
    root, l = scratch.folder(spark, "root"), table(spark, sf_dir, "lineitem")
    for version, flag in (("v1", "A"), ("v2", "R")):
        l.filter(F.col("l_returnflag") == flag).write.parquet(f"{root}/{version}")
        tables.promote(spark, root, version)
    tables.undo(spark, root)
    now = tables.current(spark, root)
    return spark.read.parquet(f"{root}/{now}").agg(F.lit(now).alias("current"), F.count(F.lit(1)).alias("n"))


@query("src_20", "select 'us-cik-' || lpad(c_custkey::varchar, 10, '0') as entity_id, c_name as name from customer")
def src_20(spark, sf_dir):
    """A registry written and loaded."""
    path = scratch.folder(spark, "registry")
    table(spark, sf_dir, "customer").select(fn.entity_id_from_cik(F.col("c_custkey")).alias("entity_id"), F.col("c_name").alias("name")).write.parquet(path)
    return spark.read.parquet(path)


@query("flt_07", "select count(*) as n from (select case when l_linenumber = 1 then 'test_feed' else 'feed' end source from lineitem) where not starts_with(source, 'test')")
def flt_07(spark, sf_dir):
    """Rows of real sources."""
    source = F.when(F.col("l_linenumber") == 1, "test_feed").otherwise("feed")
    return table(spark, sf_dir, "lineitem").select(source.alias("source")).filter(~F.col("source").startswith("test")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_08", "select l_orderkey, l_linenumber, l_partkey from lineitem join orders on l_orderkey = o_orderkey where date_trunc('month', l_shipdate) = date_trunc('month', o_orderdate)")
def flt_08(spark, sf_dir):
    """Facts of the current period only."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter(F.trunc("l_shipdate", "month") == F.trunc("o_orderdate", "month")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("flt_09", f"select concept, count(*) as n from {FACTS} where concept in ('us-gaap:A', 'us-gaap:R') group by 1")
def flt_09(spark, sf_dir):
    """Consolidated facts of curated concepts."""
    f = views.facts(spark, sf_dir).withColumn("dimensions_json", F.lit(None).cast("string"))
    return f.filter((F.coalesce("dimensions_json", F.lit("")) == "") & F.col("concept").isin("us-gaap:A", "us-gaap:R")).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


@query("fn_07", "select l_returnflag || '_per_shares' as unit, l_linestatus as local, count(*) as n from lineitem group by all")
def fn_07(spark, sf_dir):
    """Qualified names and units."""
    unit = fn.unit_label(F.concat(F.lit("iso4217:"), "l_returnflag"), F.lit("xbrli:shares"))
    return table(spark, sf_dir, "lineitem").groupBy(unit.alias("unit"), fn.local_name(F.concat(F.lit("ns:"), "l_linestatus")).alias("local")).agg(F.count(F.lit(1)).alias("n"))


@query("ext_03", f"select user_id, day, close from {views.BARS}")
def ext_03(spark, sf_dir):
    """A modality of the user's own: its key drives the winner pick."""
    return _own_modality(views.bars(spark, sf_dir))


def _own_modality(bars):
    schemas.register_modality(schemas.Modality("ticks", "close double", ("venue",), "user:ticks"))
    b = bars.select(F.col("user_id").cast("string").alias("entity_id"), F.col("day").alias("effective_date"), F.col("day").alias("availability_date"), F.lit(None).cast("date").alias("restated_at"), F.lit("x").alias("venue"), F.lit("r").alias("source_ref"), "close", "user_id", "day")
    both = b.unionByName(b.withColumns({"source_ref": F.lit("a"), "close": F.lit(-1.0)}))
    return pit.as_of(both, None, schemas.fact_key("ticks", both.columns)).select("user_id", "day", "close")


@query("opt_01", f"select 'equity_covers_gap' as rule, count(*) as checks, sum((not equity >= assets - liabilities - 1)::bigint)::bigint as violations from {STATEMENTS}")
def opt_01(spark, sf_dir):
    """A further balance rule."""
    rule = quality.Rule("equity_covers_gap", (quality.A, quality.L, quality.E), lambda v: v[quality.E] >= v[quality.A] - v[quality.L] - 1)
    by = ["l_suppkey", "fiscal_year", "fiscal_period"]
    wide = quality.pivot_concepts(views.statements(spark, sf_dir), by, list(rule.concepts), ["concept"])
    return quality.tally(quality.evaluate(wide, by, [rule])).select("rule", "checks", "violations")


@query("opt_07", f"with f as (select entity_id, count(*) n from (select distinct entity_id, effective_date, concept from {FACTS} where availability_date <= date '1996-12-31') group by 1), e as (select distinct entity_id, target_entity_id from {EDGES} where availability_date <= date '1996-12-31') select e.target_entity_id, count(*) as neighbours, sum(coalesce(f.n, 0))::bigint as facts from e left join f using (entity_id) group by 1")
def opt_07(spark, sf_dir):
    """Features of neighbours: how many suppliers a customer had by a date, and what was known of them."""
    day = "1996-12-31"
    e = resolve.quarterly_graph(views.edges(spark, sf_dir).withColumn("restated_at", F.lit(None).cast("date")), spark.range(1).select(F.lit(day).cast("date").alias("t")))
    f = pit.as_of(views.facts(spark, sf_dir), day, FACT_KEYS).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = e.select("entity_id", "target_entity_id").distinct()
    return pairs.join(f, "entity_id", "left").groupBy("target_entity_id").agg(F.count(F.lit(1)).alias("neighbours"), F.sum(F.coalesce("n", F.lit(0))).alias("facts"))
