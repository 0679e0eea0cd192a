"""Queries of pruned scans, streaming state, derived tables under late rows, and rules over tagged rows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidemark.operators import graph_log, quality
from tidemark.plans import views
from tidemark.plans.q_pit import _winner
from tidemark.plans.q_text import _event_stream
from tidemark.plans.registry import query
from tidemark.plans.views import EDGES, FACT_KEYS, FACTS, STATEMENTS, table
from tidemark.sources import manifest, scratch, schemas, tables
from tidemark.streaming import derived, newest

_NAMED = ["us-cik-0000000003", "us-cik-0000000005", "us-cik-9999999999"]


@query("src_01", f"""select entity_id, effective_date, availability_date, concept, value, source_ref from {FACTS}
    where entity_id in ('{"', '".join(_NAMED)}')""")
def src_01(spark, sf_dir):
    """Scan of named entities, one of them unknown: a table of three batches whose manifest names the files to read."""
    path, facts = scratch.folder(spark, "facts"), scratch.stored(views.facts(spark, sf_dir))  # three appends read them
    part = F.pmod(F.col("fiscal_year"), F.lit(3))
    for number in range(3):
        tables.append(facts.filter(part == number), path, number)
        manifest.index_batch(spark, path, number)
    rows, _ = manifest.read_entities(spark, path, FACT_KEYS, _NAMED)
    return rows.select("entity_id", "effective_date", "availability_date", "concept", "value", "source_ref")


@query("str_05", """select event_type, user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value
    from events group by 1, 2""")
def str_05(spark, sf_dir):
    """The newest event of each user and type of a stream, by time and then id."""
    keys, out = ["event_type", "user_id"], scratch.folder(spark, "newest")
    stream = _event_stream(spark, sf_dir).select(*keys, "ts", "event_id", "value")
    winners = newest.newest_wins(stream, keys, "ts", ["event_id"], "3650 days")
    newest.keep_newest(winners, out, scratch.folder(spark, "offsets"), keys)
    return newest.read_newest(spark, out, keys, "ts", ["event_id"]).select(*keys, "ts", "event_id", "value")


_ENDS = [datetime.date(y, m, d) for y in (1996, 1997) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]
_DAYS = f"(select unnest([{', '.join(f'''date '{d}' ''' for d in _ENDS)}]) t)"


@query("str_06", f"""select t, entity_id, count(*) as n, round(sum(value), 2) as total
    from ({_winner(f"(select t, f.* from {FACTS} f, {_DAYS} where availability_date <= t)", t="t", cols="t, entity_id, value")}) group by all""")
def str_06(spark, sf_dir):
    """Quarterly totals of what was known: a base load, late rows of some suppliers, and a refresh of what these can change."""
    log, view, facts = scratch.folder(spark, "facts"), scratch.folder(spark, "quarters"), scratch.stored(views.facts(spark, sf_dir))
    late = (F.col("availability_date") >= F.lit("1997-05-01")) & (F.col("availability_date") < F.lit("1998-01-01")) & F.col("entity_id").endswith("7")
    summarise = lambda states: states.groupBy("t", "entity_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    for number, batch in enumerate((facts.filter(~late), facts.filter(late))):
        tables.append(batch, log, number)
        derived.refresh(spark, log, view, batch, number, _ENDS, FACT_KEYS, summarise)
    return derived.read(spark, view).select("t", "entity_id", "n", "total")


@query("dq_12", f"""select 1 as absent_columns, count(*) as n, sum((fiscal_period = 'Q1')::bigint)::bigint as null_recorded_at,
    sum((value / 50000 > 1)::bigint)::bigint as belief_range, sum((concept = 'us-gaap:R')::bigint)::bigint as certainty_range,
    sum((fiscal_year % 3 = 0)::bigint)::bigint as empty_perspective, sum((availability_date < effective_date)::bigint)::bigint as negative_uncertainty from {FACTS}""")
def dq_12(spark, sf_dir):
    """Envelope conformance of facts that break its rules: no policy tags, and rows out of range by their own values."""
    raw = views.facts(spark, sf_dir).withColumns({"modality": F.lit("financials"), "source": F.lit("filings")})
    rows = schemas.conform(raw, "financials").drop("policy_tags")
    broken = {
        "recorded_at": F.when(F.col("fiscal_period") != "Q1", F.col("recorded_at")),
        "belief": F.col("value") / 50000,
        "source_certainty": F.when(F.col("concept") != "us-gaap:R", F.col("source_certainty")),
        "perspective": F.when(F.col("fiscal_year") % 3 != 0, F.col("perspective")).otherwise(""),
        "valid_from_uncertainty_days": F.datediff("availability_date", "effective_date"),
    }
    return quality.conformance(rows.withColumns(broken))


_RATIOS = [
    quality.RatioRule("federal_capital_2", "capital", "522", ("JURISDICTION_US",), "capital_ratio", 0.06, 110),
    quality.RatioRule("federal_capital_1", "capital", "522", ("JURISDICTION_US",), "capital_ratio", 0.045, 100),
    quality.RatioRule("state_capital", "capital", "52", ("STATE_NY",), "capital_ratio", 0.05, 50),
    quality.RatioRule("insurer_cover", "cover", "524", ("JURISDICTION_US",), "cover_ratio", 1.05, 100),
    quality.RatioRule("state_cover", "cover", "52", ("JURISDICTION_US", "STATE_NY"), "cover_ratio", 1.02, 50),
]


@query("opt_01_ratios", f"""with f as (select s.*, case l_suppkey % 3 when 0 then '5221' when 1 then '5241' else '3341' end industry, s_nationkey % 2 = 0 us, s_nationkey % 5 = 0 ny,
    equity / assets capital, case when l_suppkey % 7 <> 0 then assets / liabilities end cover from {STATEMENTS} s join supplier on s_suppkey = l_suppkey),
    c as (select 'capital' as "constraint", case when industry = '5221' and us then 'federal_capital_2' when industry in ('5221', '5241') and ny then 'state_capital' end as rule, capital as ratio from f where capital is not null
    union all select 'cover', case when industry = '5241' and us then 'insurer_cover' when industry in ('5221', '5241') and us and ny then 'state_cover' end, cover from f where cover is not null)
    select "constraint", rule, count(*) as checks, sum((ratio < case rule when 'federal_capital_2' then 0.06 when 'state_capital' then 0.05 when 'insurer_cover' then 1.05 else 1.02 end)::bigint)::bigint as violations
    from c where rule is not null group by 1, 2""")
def opt_01_ratios(spark, sf_dir):
    """Least ratios by industry and jurisdiction: newer and federal rules go before older ones and a state's."""
    s = views.statements_wide(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    us, ny = F.col("s_nationkey") % 2 == 0, F.col("s_nationkey") % 5 == 0
    tags = F.filter(F.array(F.when(us, F.lit("JURISDICTION_US")).otherwise("JURISDICTION_EU"), F.when(ny, F.lit("STATE_NY"))), lambda x: x.isNotNull())
    industry = F.element_at(F.array(*map(F.lit, ("5221", "5241", "3341"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    cover = F.when(F.col("l_suppkey") % 7 != 0, F.col("assets") / F.col("liabilities"))
    financials = F.create_map(F.lit("capital_ratio"), F.col("equity") / F.col("assets"), F.lit("cover_ratio"), cover)
    filings = s.select(industry.alias("industry"), tags.alias("policy_tags"), financials.alias("financials"))
    checked = quality.check_ratios(filings, _RATIOS)
    return checked.groupBy("constraint", "rule").agg(F.count("*").alias("checks"), F.sum(F.col("violated").cast("long")).alias("violations"))


_QUARTERS = [datetime.date(1996, 3, 31), datetime.date(1996, 6, 30), datetime.date(1996, 9, 30), datetime.date(1996, 12, 31)]
#: Every fifth relation ends 200 days after it is known.
_ENDING = f"(select *, case when source_ref::bigint % 5 = 0 then availability_date + 200 end as restated_at from {EDGES})"


@query("grf_04_log", f"""select strftime(t, '%Y%m%d')::int as quarter, entity_id, target_entity_id, relationship_type, availability_date, source_ref from (
    select q.t, e.*, row_number() over (partition by q.t, entity_id, target_entity_id, relationship_type order by availability_date desc, source_ref desc) as place
    from {_ENDING} e join (select unnest([date '1996-06-30', date '1996-12-31']) as t) q on availability_date <= q.t and (restated_at is null or restated_at > q.t)) where place = 1""")
def grf_04_log(spark, sf_dir):
    """Graphs of two quarters, read from a log to which four quarters each appended their changes; some relations end."""
    ends = F.when(F.col("source_ref").cast("bigint") % 5 == 0, F.date_add("availability_date", 200))
    relations, path = views.edges(spark, sf_dir).withColumn("restated_at", ends), scratch.folder(spark, "graph")
    relations = scratch.stored(relations)
    for since, t in zip([None, *_QUARTERS], _QUARTERS, strict=False):
        graph_log.append_quarter(relations, path, since, t)
    columns = ["entity_id", "target_entity_id", "relationship_type", "availability_date", "source_ref"]
    graphs = [graph_log.snapshot(spark, path, t).select(F.lit(int(f"{t:%Y%m%d}")).alias("quarter"), *columns) for t in _QUARTERS[1::2]]
    return graphs[0].unionByName(graphs[1])
