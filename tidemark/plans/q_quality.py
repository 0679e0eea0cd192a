"""Queries of the quality operators, aggregations, ranks and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators import quality
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views import BARS, EDGES, FACTS, FILINGS, STATEMENTS, table

BY = ["l_suppkey", "fiscal_year", "fiscal_period"]
_CLOSE = "abs({a} - ({b})) <= 0.01 * greatest(abs({a}), abs({b}), 1)"
_RULES = {
    "assets_eq_liabilities_plus_equity": ("soft", "true", _CLOSE.format(a="assets", b="liabilities + equity")),
    "assets_eq_liabilities_and_equity_alias": ("hard", "true", _CLOSE.format(a="assets", b="liabilities_and_equity")),
    "nonnegative_total_assets": ("hard", "true", "assets >= 0"),
    "current_assets_leq_total_assets": ("hard", "assets_current is not null", "assets_current <= assets * 1.01"),
    "current_liabilities_leq_total_liabilities": ("hard", "liabilities_current is not null", "liabilities_current <= liabilities * 1.01"),
    "nonnegative_equity": ("soft", "true", "equity >= 0"),
}
_VERDICTS = "(" + " union all ".join(f"select {', '.join(BY)}, '{n}' as rule, '{s}' as severity, 'financials' as modality, {ok} as ok from {STATEMENTS} where {applies}" for n, (s, applies, ok) in _RULES.items()) + ")"
_TALLY = f"(select rule, severity, modality, count(*) as checks, sum((not ok)::bigint)::bigint as violations, sum((not ok)::bigint) / count(*) as rate from {_VERDICTS} group by 1, 2, 3)"


def _verdicts(spark, sf_dir, rules=quality.ACCOUNTING_RULES):
    concepts = list(dict.fromkeys(c for r in rules for c in r.concepts))
    return quality.evaluate(quality.pivot_concepts(views.statements(spark, sf_dir), BY, concepts, ["concept"]), BY, rules)


@query("dq_01", f"select * from {_TALLY}")
def dq_01(spark, sf_dir):
    """All accounting rules over all statements, tallied."""
    return quality.tally(_verdicts(spark, sf_dir))


def _one(number: int, rule: quality.Rule) -> None:
    @query(f"dq_{number:02d}", f"select {', '.join(BY)}, rule, ok from {_VERDICTS} where rule = '{rule.name}' and not ok")
    def violations(spark, sf_dir):
        return _verdicts(spark, sf_dir, [rule]).filter("not ok").select(*BY, "rule", "ok")

    violations.__doc__ = f"Statements that violate {rule.name}."


for _i, _rule in enumerate(quality.ACCOUNTING_RULES):
    _one(_i + 2, _rule)


@query("dq_08", f"select accession, 'filed_in_time' as rule, 'hard' as severity, 'filings' as modality, filed - report_date <= 90 as ok from {FILINGS}")
def dq_08(spark, sf_dir):
    """Filings within ninety days."""
    return quality.late_filings(views.filings(spark, sf_dir))


@query("dq_09", f"select sum(checks)::bigint as hard_checks, sum(violations)::bigint as hard_violations, sum(violations) / sum(checks) as cvr, sum(violations) / sum(checks) <= 0.02 as passed from {_TALLY} where severity = 'hard'")
def dq_09(spark, sf_dir):
    """The gate on hard violations."""
    return quality.gate(quality.tally(_verdicts(spark, sf_dir)))


@query("agg_05", f"select modality, sum(checks)::bigint as checks, sum(violations)::bigint as violations, sum(violations) / sum(checks) as cvr, sum(violations) / sum(checks) <= 0.02 as passed from {_TALLY} where severity = 'hard' group by 1")
def agg_05(spark, sf_dir):
    """Hard violations by modality."""
    return quality.by_modality(quality.tally(_verdicts(spark, sf_dir)))


@query("top_03", f"select * from (select {', '.join(BY)}, rule, row_number() over (partition by rule order by {', '.join(BY)}) as place from {_VERDICTS} where not ok) where place <= 10")
def top_03(spark, sf_dir):
    """Ten examples of each rule's violations."""
    return quality.examples(_verdicts(spark, sf_dir), BY).select(*BY, "rule", F.col("place").cast("long").alias("place"))


@query("ext_01", f"select 'equity_below_half' as rule, 'soft' as severity, 'financials' as modality, count(*) as checks, sum((not equity <= assets * 0.5)::bigint)::bigint as violations, sum((not equity <= assets * 0.5)::bigint) / count(*) as rate from {STATEMENTS}")
def ext_01(spark, sf_dir):
    """A user's own rule."""
    rule = quality.Rule("equity_below_half", (quality.A, quality.E), lambda v: v[quality.E] <= v[quality.A] * 0.5, "soft")
    return quality.tally(_verdicts(spark, sf_dir, [rule]))


@query("agg_04", f"select {', '.join(BY)}, round(assets) as assets, round(equity) as equity, round(assets_current) as assets_current from {STATEMENTS}")
def agg_04(spark, sf_dir):
    """Concepts as columns of one row for each statement."""
    w = quality.pivot_concepts(views.statements(spark, sf_dir), BY, [quality.A, quality.E, quality.AC], ["concept"])
    return w.select(*BY, *(F.round(F.col(f"`{c}`.value"), 0).alias(n) for c, n in ((quality.A, "assets"), (quality.E, "equity"), (quality.AC, "assets_current"))))


@query("agg_03", f"select accession, report_date, filed, (filed - report_date)::integer as lag_days from {FILINGS}")
def agg_03(spark, sf_dir):
    """Each filing's report date, filing date and lag."""
    return views.filings(spark, sf_dir).select("accession", "report_date", "filed", F.datediff("filed", "report_date").alias("lag_days"))


@query("fn_18", f"select (filed - report_date)::integer as lag_days, count(*) as n from {FILINGS} group by 1")
def fn_18(spark, sf_dir):
    """How filing lags are spread."""
    return views.filings(spark, sf_dir).groupBy(F.datediff("filed", "report_date").alias("lag_days")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_06", "select * from (values ('customer', (select count(*) from customer)), ('orders', (select count(*) from orders)), ('events', (select count(*) from events))) v(modality, n)")
def agg_06(spark, sf_dir):
    """Rows of each table."""
    one = [table(spark, sf_dir, m).agg(F.lit(m).alias("modality"), F.count(F.lit(1)).alias("n")) for m in ("customer", "orders", "events")]
    return one[0].union(one[1]).union(one[2])


@query("agg_07", f"select count(*) as entities, list_sort(list(q))[len(list(q)) // 2 + 1] as upper_median from (select entity_id, count(distinct (fiscal_year, fiscal_period)) q from {FACTS} group by 1)")
def agg_07(spark, sf_dir):
    """Upper median of the quarters that entities cover: the middle is picked by ranges of the count, not by collecting it."""
    per = views.facts(spark, sf_dir).groupBy("entity_id").agg(F.count_distinct("fiscal_year", "fiscal_period").alias("q"))
    hist = per.groupBy("q").agg(F.count(F.lit(1)).alias("c"))  # as many rows as there are different counts
    upto = F.sum("c").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(F.lit(1)))
    return hist.select("q", upto.alias("upto"), total.alias("entities")).filter(F.col("upto") > F.floor(F.col("entities") / 2)).groupBy("entities").agg(F.min("q").alias("upper_median"))


@query("agg_08", f"select min(q) as least, median(q) as median, max(q) as most, avg(q) as mean from (select entity_id, count(distinct (fiscal_year, fiscal_period)) q from {FACTS} group by 1)")
def agg_08(spark, sf_dir):
    """Quarters of entities: least, median, most, mean."""
    per = views.facts(spark, sf_dir).groupBy("entity_id").agg(F.count_distinct("fiscal_year", "fiscal_period").alias("q"))
    return per.agg(F.min("q").alias("least"), F.median("q").alias("median"), F.max("q").alias("most"), F.avg("q").alias("mean"))


@query("agg_09", f"select 'facts' as modality, count(distinct entity_id) as entities, count(*) as n from {FACTS} union all select 'relations', count(distinct entity_id), count(*) from {EDGES}")
def agg_09(spark, sf_dir):
    """Entities and rows of each modality."""
    count = lambda df, m: df.agg(F.lit(m).alias("modality"), F.count_distinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("n"))
    return count(views.facts(spark, sf_dir), "facts").union(count(views.edges(spark, sf_dir), "relations"))


@query("agg_10", "select event_type, props->>'k' as facet, count(*) as n from events group by 1, 2")
def agg_10(spark, sf_dir):
    """Counts by type and facet of a JSON column."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("facet")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_11", f"select cik, arg_max(accession, {{'f': filed, 'a': accession}}) as accession, max(filed) as filed from {FILINGS} group by 1")
def agg_11(spark, sf_dir):
    """The latest filing of each filer."""
    return views.filings(spark, sf_dir).groupBy("cik").agg(F.max_by("accession", F.struct("filed", "accession")).alias("accession"), F.max("filed").alias("filed"))


@query("agg_13", "select cast(o_orderdate as date) as day, count(*) as filings, count(distinct o_custkey) as filers, round(sum(o_totalprice), 2) as volume, sum((o_orderstatus = 'F')::bigint)::bigint as amended from orders group by 1")
def agg_13(spark, sf_dir):
    """Daily load statistics."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("filings"), F.count_distinct("o_custkey").alias("filers"), F.round(F.sum("o_totalprice"), 2).alias("volume"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("amended"))


@query("agg_14", f"select year(availability_date) || '-Q' || quarter(availability_date) as quarter, count(distinct (entity_id, target_entity_id, relationship_type)) as n from {EDGES} group by 1")
def agg_14(spark, sf_dir):
    """Relations in each quarter."""
    return views.edges(spark, sf_dir).groupBy(fn.quarter_label(F.col("availability_date")).alias("quarter")).agg(F.count_distinct("entity_id", "target_entity_id", "relationship_type").alias("n"))


@query("dq_10", f"select 'entities' as name, count(distinct entity_id) >= 50 as passed, count(distinct entity_id)::varchar as observed from {FACTS} union all select 'sentinel', count(*) > 0, count(*)::varchar from {FACTS} where entity_id = 'us-cik-0000000001' union all select 'broken', false, ''")
def dq_10(spark, sf_dir):
    """Coverage gates; a check that raises has failed."""
    f = views.facts(spark, sf_dir)

    def entities():
        n = f.select("entity_id").distinct().count()
        return n >= 50, n, "at least fifty entities"

    def sentinel():
        n = f.filter("entity_id = 'us-cik-0000000001'").count()
        return n > 0, n, "a known entity"

    def broken():
        raise RuntimeError("no such table")

    return quality.run_checks({"entities": entities, "sentinel": sentinel, "broken": broken}, spark).select("name", "passed", "observed")


_YEAR = "(select l_returnflag, count(*) n from lineitem where year(l_shipdate) = {y} group by 1)"
_DRIFT = f"select coalesce(a.l_returnflag, b.l_returnflag) as l_returnflag, coalesce(a.n, 0) as now, coalesce(b.n, 0) as prior, (coalesce(a.n, 0) - coalesce(b.n, 0)) / greatest(abs(coalesce(b.n, 0)), 1) as delta, abs((coalesce(a.n, 0) - coalesce(b.n, 0)) / greatest(abs(coalesce(b.n, 0)), 1)) > 0.05 as material from {_YEAR.format(y=1997)} a full join {_YEAR.format(y=1996)} b on a.l_returnflag = b.l_returnflag"


def _drift(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    count = lambda y: l.filter(F.year("l_shipdate") == y).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return quality.drift(count(1997), count(1996), ["l_returnflag"], "n")


@query("dq_11", _DRIFT)
def dq_11(spark, sf_dir):
    """Drift of yearly counts against the year before."""
    return _drift(spark, sf_dir)


@query("jn_11", f"select l_returnflag, now, prior from ({_DRIFT})")
def jn_11(spark, sf_dir):
    """Both sides of a baseline comparison."""
    return _drift(spark, sf_dir).select("l_returnflag", "now", "prior")


@query("fn_21", f"select l_returnflag, delta from ({_DRIFT})")
def fn_21(spark, sf_dir):
    """Relative changes."""
    return _drift(spark, sf_dir).select("l_returnflag", "delta")


@query("src_05", f"select entity_id, source_ref, 1.0 as belief, 'sec_edgar:xbrl_instance' as perspective, 0 as valid_from_uncertainty_days from {FACTS}")
def src_05(spark, sf_dir):
    """Facts with the envelope's defaults filled in."""
    from tidemark.sources.schemas import backfill

    return backfill(views.facts(spark, sf_dir), "financials").select("entity_id", "source_ref", "belief", "perspective", "valid_from_uncertainty_days")


@query("dq_13", f"select count(*) as n, sum((high < low)::bigint)::bigint as high_below_low, sum((not close between low and high)::bigint)::bigint as close_outside from {BARS}")
def dq_13(spark, sf_dir):
    """Price bars out of order."""
    return quality.bar_faults(views.bars(spark, sf_dir))


@query("dq_14", "select count(*) as n, sum((not lag between 35 and 50)::bigint)::bigint as outside from (select (cast(date_trunc('week', d + 42 + 5) as date) + 1 - d) lag from (select cast(o_orderdate as date) d from orders))")
def dq_14(spark, sf_dir):
    """Release lags within 35 to 50 days."""
    d = F.to_date("o_orderdate")
    lag = F.datediff(fn.labour_release(d), d)
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.sum((~lag.between(35, 50)).cast("long")).alias("outside"))


@query("dq_15", "select p_name, count(*) as n from part group by 1 having count(*) > 1")
def dq_15(spark, sf_dir):
    """Names that several parts share."""
    return quality.duplicates(table(spark, sf_dir, "part"), ["p_name"])


@query("set_02", "select distinct l_suppkey, l_returnflag, l_linestatus from lineitem")
def set_02(spark, sf_dir):
    """Distinct rows."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("set_03", "select c_custkey from customer except select o_custkey from orders")
def set_03(spark, sf_dir):
    """Customers without orders."""
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("jn_08", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def jn_08(spark, sf_dir):
    """The same as an anti join."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("set_04", "select c_nationkey as k from customer union select s_nationkey from supplier")
def set_04(spark, sf_dir):
    """Union of keys."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("set_05", "select distinct o_custkey from orders")
def set_05(spark, sf_dir):
    """Keys to dispatch, each once."""
    return table(spark, sf_dir, "orders").select("o_custkey").dropDuplicates(["o_custkey"])


@query("win_07", f"select * from (select cik, accession, filed, row_number() over (partition by cik order by filed desc, accession desc) as place from {FILINGS}) where place > 3 and filed < date '1998-01-01'")
def win_07(spark, sf_dir):
    """What a retention of the newest three and everything since 1998 prunes."""
    w = Window.partitionBy("cik").orderBy(F.desc("filed"), F.desc("accession"))
    return views.filings(spark, sf_dir).select("cik", "accession", "filed", F.row_number().over(w).cast("long").alias("place")).filter("place > 3 and filed < date '1998-01-01'")


@query("top_04", f"select cik, accession, filed from (select *, row_number() over (partition by cik order by filed desc, accession desc) place from {FILINGS}) where place <= 5")
def top_04(spark, sf_dir):
    """The newest five filings of each filer."""
    w = Window.partitionBy("cik").orderBy(F.desc("filed"), F.desc("accession"))
    return views.filings(spark, sf_dir).withColumn("place", F.row_number().over(w)).filter("place <= 5").select("cik", "accession", "filed")


@query("top_05", f"select user_id, day, close from (select *, row_number() over (partition by user_id order by day desc) place from {BARS}) where place <= 3")
def top_05(spark, sf_dir):
    """The latest three bars of each series."""
    w = Window.partitionBy("user_id").orderBy(F.desc("day"))
    return views.bars(spark, sf_dir).withColumn("place", F.row_number().over(w)).filter("place <= 3").select("user_id", "day", "close")


@query("top_07", "select event_type, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as written_at from events group by 1")
def top_07(spark, sf_dir):
    """The newest row of each name."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("written_at"))


@query("opt_05", "select user_id, cast(date_trunc('month', ts) as date) as month, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, count(*) as volume from events group by 1, 2")
def opt_05(spark, sf_dir):
    """Monthly bars rolled up from daily ones."""
    b = views.bars(spark, sf_dir)
    return b.groupBy("user_id", F.to_date(F.trunc("day", "month")).alias("month")).agg(F.min_by("open", "day").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "day").alias("close"), F.sum("volume").alias("volume"))


@query("opt_02", f"select user_id, round(1 - exp(sum(ln(1 - p))), 6) as risk from (select user_id, case when close < 0.5 * lag(close) over w then 0.3 when close < lag(close) over w then 0.1 else 0 end p from {BARS} window w as (partition by user_id order by day)) group by 1")
def opt_02(spark, sf_dir):
    """Soft signals of falling bars, combined by noisy-or."""
    prior = F.lag("close").over(Window.partitionBy("user_id").orderBy("day"))
    p = F.when(F.col("close") < prior * 0.5, 0.3).when(F.col("close") < prior, 0.1).otherwise(0.0)
    return views.bars(spark, sf_dir).select("user_id", p.alias("p")).groupBy("user_id").agg(F.round(1 - F.exp(F.sum(F.ln(1 - F.col("p")))), 6).alias("risk"))


@query("opt_08", "select least(floor(l_discount * 100), 9)::integer as bin, count(*) as n, round(avg(l_discount), 6) as predicted, round(avg((l_returnflag = 'R')::integer), 6) as observed from lineitem group by 1")
def opt_08(spark, sf_dir):
    """Calibration by bins of the predicted share."""
    b = F.least(F.floor(F.col("l_discount") * 100), F.lit(9)).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("predicted"), F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("observed"))
