"""Queries of inventory items that share another query's code, each under its own name, and the wider forms of some."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators import pit, quality, resolve, text
from tidemark.plans import views
from tidemark.plans.q_pit import _AMEND
from tidemark.plans.registry import query
from tidemark.plans.views import BARS, FACTS, STATEMENTS, table
from tidemark.sources import loaders, schemas, scratch, tables
from tidemark.streaming import jobs

# --- projections, ordinals


@query("prj_02", "select source as entity_id, doc_id::varchar as accession, 0 as chunk_idx, length(text)::integer as n_chars, 'press_release' as coverage_class, 'derived:filings_text/8-K_item_2.02' as perspective from documents where text is not null")
def prj_02(spark, sf_dir):
    """Text chunks as excerpts."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    chunks = d.select(F.col("source").alias("entity_id"), F.col("doc_id").cast("string").alias("accession"), F.lit("8-K").alias("form"), F.lit("2.02").alias("item_id"), F.lit(0).alias("chunk_idx"), "text", F.length("text").alias("n_chars"), fn.approx_tokens(F.col("text")).alias("n_tokens_approx"))
    return text.excerpts(chunks).select("entity_id", "accession", "chunk_idx", "n_chars", "coverage_class", "perspective")


@query("prj_03", "select 'us-cik-' || lpad(l_suppkey::varchar, 10, '0') as entity_id, l_orderkey || '#' || l_linenumber as source_ref, l_partkey::varchar as insider_cik, l_quantity as shares, (l_linestatus = 'O') as is_derivative, 'sec_edgar:form4' as perspective, 1.0::double as belief from lineitem")
def prj_03(spark, sf_dir):
    """Trades as canonical rows of their modality."""
    l = table(spark, sf_dir, "lineitem")
    trades = l.select(
        fn.entity_id_from_cik(F.col("l_suppkey")).alias("entity_id"), F.lit("insider_trades").alias("modality"), F.to_date("l_shipdate").alias("effective_date"), F.to_date("l_shipdate").alias("availability_date"), F.lit(None).cast("date").alias("restated_at"), F.lit("form4").alias("source"),
        F.concat_ws("#", "l_orderkey", "l_linenumber").alias("source_ref"), F.col("l_partkey").cast("string").alias("insider_cik"), F.col("l_quantity").alias("shares"), (F.col("l_linestatus") == "O").alias("is_derivative"),
    )
    return schemas.conform(trades, "insider_trades").select("entity_id", "source_ref", "insider_cik", "shares", "is_derivative", "perspective", "belief")


@query("win_03", "select l_orderkey::varchar as accession, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::integer as transaction_index, l_quantity as shares from lineitem")
def win_03(spark, sf_dir):
    """Transactions numbered within their filing, in the order that it reports them."""
    value = lambda tag, c: F.concat(F.lit(f"<{tag}><value>"), c.cast("string"), F.lit(f"</value></{tag}>"))
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("day"))
    filings = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("t"), F.max(F.to_date("l_shipdate")).alias("filed"))
    rows = F.array_join(F.transform("t", lambda t: F.concat(F.lit("<nonDerivativeTransaction>"), value("securityTitle", F.lit("Common")), value("transactionDate", t["day"]), F.lit("<transactionAmounts>"), value("transactionShares", t["l_quantity"]), F.lit("</transactionAmounts></nonDerivativeTransaction>"))), "")
    xml = F.concat(F.lit("<ownershipDocument><documentType>4</documentType><issuer><issuerCik>1</issuerCik></issuer><nonDerivativeTable>"), rows, F.lit("</nonDerivativeTable></ownershipDocument>"))
    return loaders.ownership_trades(filings.select(F.col("l_orderkey").cast("string").alias("accession"), "filed", xml.alias("content"))).select("accession", "transaction_index", "shares")


# --- scalar functions


@query("fn_01", "select c_custkey, 'us-cik-' || lpad(c_custkey::varchar, 10, '0') as entity_id from customer")
def fn_01(spark, sf_dir):
    """Entity ids of zero-padded numbers."""
    return table(spark, sf_dir, "customer").select("c_custkey", fn.entity_id_from_cik(F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("entity_id"))


@query("fn_04", "select p_partkey, 'unresolved:' || case when p_partkey % 5 = 0 then 'empty' else left(p_name || ' ' || p_type || ' ' || p_name || ' ' || p_type, 50) end as id from part")
def fn_04(spark, sf_dir):
    """Placeholders of names that nothing resolves."""
    name = F.when(F.col("p_partkey") % 5 == 0, F.lit("  ")).otherwise(F.concat_ws(" ", "p_name", "p_type", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.unresolved(name).alias("id"))


@query("fn_06", "select case when l_linestatus = 'O' then 'us-gaap:Tag' || l_returnflag when l_returnflag = 'N' then 'custom:unknown' else 'custom:Tag' || l_returnflag end as concept, count(*) as n from lineitem group by 1")
def fn_06(spark, sf_dir):
    """Concepts of tags and their taxonomy versions."""
    version = F.when(F.col("l_linestatus") == "O", "us-gaap/2024").when(F.col("l_returnflag") == "N", F.lit(None)).otherwise("0000320193")
    return table(spark, sf_dir, "lineitem").groupBy(fn.concept_name(F.concat(F.lit("Tag"), "l_returnflag"), version).alias("concept")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = ["a.htm", "b.HTML", "c.xml", "d.xsd", "e.txt", "f.pdf", "g.jpeg", "h.xlsx", "i", "j.html.zip"]
_KINDS = ["text/html", "text/html", "application/xml", "application/xml", "text/plain", "application/pdf", "image/jpeg", "application/vnd.ms-excel", "application/octet-stream", "application/octet-stream"]


@query("fn_08", f"select p_partkey, {_KINDS}[p_partkey % 10 + 1] as kind from part")
def fn_08(spark, sf_dir):
    """Kinds of files by their names."""
    name = F.concat(F.lit("x"), F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 10 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", fn.mime_type(name).alias("kind"))


@query("fn_09", "select doc_id, sha256(text) as digest, left(sha1(text), 12) as short from documents")
def fn_09(spark, sf_dir):
    """Content hashes, whole and short."""
    raw = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", fn.content_hash(raw).alias("digest"), fn.short_hash(raw).alias("short"))


@query("fn_11", "select year(l_shipdate) || '-Q' || quarter(l_shipdate) as quarter, count(*) as n from lineitem group by 1")
def fn_11(spark, sf_dir):
    """Quarter labels."""
    return table(spark, sf_dir, "lineitem").groupBy(fn.quarter_label(F.col("l_shipdate")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_12", "select doc_id, (length(text) // 4)::integer as tokens from documents")
def fn_12(spark, sf_dir):
    """Approximate tokens of whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.approx_tokens(F.col("text")).alias("tokens"))


@query("fn_13", "select o_orderkey, case o_orderkey % 5 when 0 then null when 1 then null when 2 then null else cast(o_orderdate as date) end as day from orders")
def fn_13(spark, sf_dir):
    """Compact dates as text, with a fraction, with a time, out of range, too short."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    raw = F.when(k % 5 == 0, F.lit("19960231")).when(k % 5 == 1, F.substring(day, 1, 7)).when(k % 5 == 2, F.lit(None).cast("string")).when(k % 5 == 3, F.concat(day, F.lit(".0"))).otherwise(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.compact_date(raw).alias("day"))


@query("fn_14", "select o_orderkey, case o_orderkey % 3 when 0 then null else cast(o_orderdate as date) end as day from orders")
def fn_14(spark, sf_dir):
    """Dates that texts start with."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k % 3 == 0, F.lit("1996-02-31T00:00:00")).when(k % 3 == 1, F.concat(day, F.lit("T12:30:00Z"))).otherwise(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.iso_date(raw).alias("day"))


@query("fn_19", "select l_linenumber, count(*) as n, sum((abs(l_quantity - l_quantity * (1 + l_tax - 0.04)) <= 0.01 * greatest(abs(l_quantity), abs(l_quantity * (1 + l_tax - 0.04)), 1))::bigint)::bigint as close from lineitem group by 1")
def fn_19(spark, sf_dir):
    """How many amounts are within one per cent of each other."""
    q = F.col("l_quantity")
    near = fn.close_to(q, q * (1 + F.col("l_tax") - 0.04), 0.01)
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(near.cast("long")).alias("close"))


@query("fn_20_inverse", "select l_orderkey, l_linenumber, l_partkey, round(l_tax - l_discount, 6) as x from lineitem")
def fn_20_inverse(spark, sf_dir):
    """Signed logarithms undone."""
    x = fn.signed_exp(fn.signed_log(F.col("l_tax") - F.col("l_discount")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(x, 6).alias("x"))


@query("fn_22", "select l_orderkey, l_linenumber, l_partkey, round(case when l_linestatus = 'O' then -1 else 1 end * round(l_extendedprice, 2) * [1, 1000, 1000000][l_linenumber % 3 + 1], 2) as x from lineitem")
def fn_22(spark, sf_dir):
    """Displayed numbers with separators, scales and signs."""
    shown = F.format_number("l_extendedprice", 2)
    scale = ((F.col("l_linenumber") % 3) * 3).cast("int")
    x = fn.scaled_number(shown, scale, F.when(F.col("l_linestatus") == "O", "-").otherwise(""))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(x, 2).alias("x"))


@query("fn_25", "select o_orderkey, [5, 1, 2, 3, 4, 1, 0][o_orderkey % 7 + 1] as place from orders")
def fn_25(spark, sf_dir):
    """Order of fiscal periods."""
    names = F.array(*map(F.lit, ["FY", "Q1", "Q2", "Q3", "Q4", "Q", "H1"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.fiscal_order(F.element_at(names, (F.col("o_orderkey") % 7 + 1).cast("int"))).cast("int").alias("place"))


@query("fn_26", "select o_orderkey, ['FY', 'Q3', 'Q', '8-K'][o_orderkey % 4 + 1] as period from orders")
def fn_26(spark, sf_dir):
    """Fiscal periods of forms, with and without a hint."""
    k = F.col("o_orderkey") % 4
    form = F.when(k == 0, "10-K405").when(k == 3, "8-K").otherwise("10-Q")
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.fiscal_period_of_form(form, F.when(k == 1, "Q3").otherwise("")).alias("period"))


@query("fn_16_spines", "with e as (select o_custkey, min(cast(o_orderdate as date)) a, max(cast(o_orderdate as date)) b from orders group by 1) select o_custkey, 'month' as step, last_day(cast(q as date)) as period_end from e, unnest(generate_series(date_trunc('month', a), b, interval 1 month)) u(q) where last_day(cast(q as date)) between a and b union all select o_custkey, 'year', make_date(y, 12, 31) from e, (select unnest(range(1980, 2040)) y) where make_date(y, 12, 31) between a and b")
def fn_16_spines(spark, sf_dir):
    """Month and year ends in each customer's span of orders."""
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    ends = lambda step, months: spans.select("o_custkey", F.lit(step).alias("step"), F.explode(fn.period_ends(F.col("a"), F.col("b"), months)).alias("period_end"))
    return ends("month", 1).union(ends("year", 12))


# --- registry, archive, ranks


@query("jn_03_ticker", "select u.user_id, c.c_name as name, 'us-cik-' || lpad(c.c_custkey::varchar, 10, '0') as entity_id from (select distinct user_id from events) u left join customer c on 'TK' || c.c_custkey = 'TK' || u.user_id")
def jn_03_ticker(spark, sf_dir):
    """Registry lookup by ticker, whatever its case."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("ticker", F.concat(F.lit(" tK"), "user_id"))
    reg = table(spark, sf_dir, "customer").select(F.concat(F.lit("TK"), "c_custkey").alias("ticker"), F.col("c_name").alias("name"), fn.entity_id_from_cik(F.col("c_custkey")).alias("entity_id"), F.col("c_custkey").alias("pos"))
    return resolve.by_ticker(users, reg).select("user_id", "name", "entity_id")


@query("src_21_store", "select conv_id, turn, coalesce(row_number() over (partition by text order by conv_id, turn) = 1 and text not in (select text from conversations where turn = 0 and text is not null), false) as was_new from conversations where text is not null")
def src_21_store(spark, sf_dir):
    """Arrivals against a store that holds some of their bodies: only the first of a new body is new."""
    c = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.col("text").alias("body"))
    stored, _ = tables.archive(c.filter("turn = 0"), c.limit(0).select(F.lit("").alias("sha1")), ["conv_id", "turn"])
    _, log = tables.archive(c, stored.select("sha1"), ["conv_id", "turn"])
    return log.select("conv_id", "turn", "was_new")


@query("top_05_slots", "select 'patent' as kind, p_brand as slot, p_partkey as id from (select *, row_number() over (partition by p_brand order by p_partkey) place from part) where place <= 3 union all select 'event', strftime(slot, '%Y-%m-%d %H:%M'), event_id from (select *, time_bucket(interval 15 minute, ts) slot, row_number() over (partition by time_bucket(interval 15 minute, ts) order by event_id) place from events) where place <= 2")
def top_05_slots(spark, sf_dir):
    """The first three patents of each holder and the first two events of each quarter of an hour."""
    first = lambda df, by, key, n: df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(key))).filter(F.col("place") <= n)
    p = first(table(spark, sf_dir, "part"), "p_brand", "p_partkey", 3).select(F.lit("patent").alias("kind"), F.col("p_brand").alias("slot"), F.col("p_partkey").alias("id"))
    e = table(spark, sf_dir, "events").withColumn("slot", F.date_format(F.window("ts", "15 minutes")["start"], "yyyy-MM-dd HH:mm"))
    return p.union(first(e, "slot", "event_id", 2).select(F.lit("event").alias("kind"), "slot", F.col("event_id").alias("id")))


# --- all ten modalities

_CIK = "'us-cik-' || lpad(cast({} as string), 10, '0') as entity_id"
_L = [_CIK.format("l_suppkey"), "cast(l_shipdate as date) as effective_date", "cast(l_shipdate as date) as availability_date", "cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) as source_ref"]
_O = [_CIK.format("o_custkey"), "cast(o_orderdate as date) as effective_date", "cast(o_orderdate as date) as availability_date", "cast(o_orderkey as string) as source_ref"]
_E = [_CIK.format("user_id"), "cast(ts as date) as effective_date", "cast(ts as date) as availability_date", "cast(event_id as string) as source_ref"]
#: Each modality as columns of a table, in expressions that both engines read; the keys are those that the registry declares.
_MODALITIES = {
    "financials": ("lineitem", [*_L, "l_returnflag as concept", "cast(year(l_shipdate) as int) as fiscal_year"]),
    "insider_trades": ("lineitem", [*_L, "cast(l_partkey as string) as insider_cik", "l_linestatus as security_title", "l_linenumber as transaction_index"]),
    "supply_chain": ("lineitem", [*_L, "cast(l_partkey as string) as target_entity_id", "l_returnflag as relationship_type", "l_linestatus as evidence_hash"]),
    "filings_text": ("orders", [*_O, "o_orderstatus as form", "o_orderpriority as item_id", "0 as chunk_idx"]),
    "earnings_calls": ("orders", [*_O, "o_orderpriority as accession", "0 as chunk_idx"]),
    "macro": ("orders", [*_O, "o_orderpriority as series_id"]),
    "patents": ("orders", [*_O, "o_orderstatus as patent_number"]),
    "hiring": ("orders", [*_O, "o_orderpriority as measure"]),
    "market": ("events", [*_E, "'daily' as frequency"]),
    "news": ("events", [*_E, "event_type as global_event_id"]),
}


def _keys(modality: str) -> list[str]:
    return schemas.fact_key(modality, [c.split(" as ")[-1] for c in _MODALITIES[modality][1]])


def _modalities(spark, sf_dir) -> dict:
    return {m: table(spark, sf_dir, t).selectExpr(*columns).withColumn("restated_at", F.lit(None).cast("date")) for m, (t, columns) in _MODALITIES.items()}


_ENTITIES = ["us-cik-0000000001", "us-cik-0000000002", "us-cik-0000000003"]
_AT = "2024-01-15"
_STATES = " union all ".join(f"select '{m}' as modality, count(distinct ({', '.join(_keys(m))})) as n from (select {', '.join(columns)} from {t}) where entity_id in ({', '.join(map(repr, _ENTITIES))}) and availability_date <= date '{_AT}'" for m, (t, columns) in _MODALITIES.items())


@query("pit_02_modalities", f"select modality, n, n = 0 as is_empty from ({_STATES})")
def pit_02_modalities(spark, sf_dir):
    """Snapshot of some entities in all ten modalities: rows of each, and whether it is empty."""
    snap = pit.snapshot(_modalities(spark, sf_dir), _ENTITIES, _AT, {m: _keys(m) for m in _MODALITIES})
    return quality.sizes(snap)


@query("agg_09_breadth", " union all ".join(f"select '{m}' as modality, count(distinct entity_id) as entities, count(*) as n from (select {', '.join(columns)} from {t})" for m, (t, columns) in _MODALITIES.items()))
def agg_09_breadth(spark, sf_dir):
    """Entities and rows of all ten modalities."""
    return quality.breadth(_modalities(spark, sf_dir))


_QUARTERS = f"(select entity_id, count(distinct (fiscal_year, fiscal_period)) q from {FACTS} group by 1)"


@query("dq_10_gates", f"select 'modalities' as name, count(*) >= 10 as passed, count(*)::varchar as observed from ({_STATES.replace(f'where entity_id in ({", ".join(map(repr, _ENTITIES))}) and', 'where')}) where n > 0 union all select 'median_quarters', list_sort(list(q))[len(list(q)) // 2 + 1] >= 60, (list_sort(list(q))[len(list(q)) // 2 + 1])::varchar from {_QUARTERS} union all select 'sentinel', count(*) > 0, count(*)::varchar from {FACTS} where entity_id = 'us-cik-0000000001' and concept = 'us-gaap:A' union all select 'entities', count(*) >= 1000, count(*)::varchar from {_QUARTERS}")
def dq_10_gates(spark, sf_dir):
    """The coverage gates: ten modalities, sixty quarters at the median, a known fact, a thousand entities."""
    known = {m: df.filter(F.col("availability_date") <= F.lit(_AT).cast("date")) for m, df in _modalities(spark, sf_dir).items()}
    f = views.facts(spark, sf_dir)
    checks = quality.coverage_checks(known, f, (F.col("entity_id") == "us-cik-0000000001") & (F.col("concept") == "us-gaap:A"))
    return quality.run_checks(checks, spark).select("name", "passed", "observed")


@query("ext_02", "select 'orders_have_customers' as name, count(*) = 0 as passed, count(*)::varchar as observed from orders where o_custkey not in (select c_custkey from customer) union all select 'no_such_table', false, ''")
def ext_02(spark, sf_dir):
    """A user's own coverage checks over the tables; one that raises has failed."""

    def customers():
        c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
        n = table(spark, sf_dir, "orders").join(c, "o_custkey", "left_anti").count()
        return n == 0, n, "orders without customer"

    return quality.run_checks({"orders_have_customers": customers, "no_such_table": lambda: table(spark, sf_dir, "absent").count()}, spark).select("name", "passed", "observed")


@query("ext_04", "select doc_id, (i - 1)::integer as pos, length(line)::integer as n_chars from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null) where line <> ''")
def ext_04(spark, sf_dir):
    """A user's own generator of rows from texts: lines with their places."""

    def lines(body):
        return [(i, len(x)) for i, x in enumerate(body.split("\n")) if x]

    return text.generate(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text", lines, "pos int, n_chars int")


# --- optional backlog, wider


@query("opt_01_rules", " union all ".join(f"select '{n}' as rule, count(*) as checks, sum((not {ok})::bigint)::bigint as violations from {STATEMENTS} where {has}" for n, ok, has in (("nonnegative_liabilities", "liabilities >= 0", "liabilities is not null"), ("working_capital_leq_assets", "assets_current - liabilities_current <= assets", "assets_current is not null and liabilities_current is not null"))))
def opt_01_rules(spark, sf_dir):
    """Further balance rules: signs and working capital."""
    by = ["l_suppkey", "fiscal_year", "fiscal_period"]
    rules = quality.FURTHER_RULES
    wide = quality.pivot_concepts(views.statements(spark, sf_dir), by, list(dict.fromkeys(c for r in rules for c in r.concepts)), ["concept"])
    return quality.tally(quality.evaluate(wide, by, rules)).select("rule", "checks", "violations")


@query("opt_01_cash", "select 'cash_flow_identity' as rule, count(*) as checks, sum((not abs(c - s) <= 0.01 * greatest(abs(c), abs(s), 1))::bigint)::bigint as violations from (select s, s * (case when o_custkey % 10 = 0 then 1.05 else 1 end) c from (select o_custkey, sum(case when o_orderstatus = 'F' then o_totalprice else 0 end) - sum(case when o_orderstatus = 'O' then o_totalprice else 0 end) + sum(case when o_orderstatus = 'P' then o_totalprice else 0 end) s from orders group by 1))")
def opt_01_cash(spark, sf_dir):
    """The change in cash against the three flows."""
    o = table(spark, sf_dir, "orders")
    flow = lambda s, sign: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice") * sign).otherwise(0.0))
    flows = o.groupBy("o_custkey").agg(flow("F", 1).alias("a"), flow("O", -1).alias("b"), flow("P", 1).alias("c"))
    change = (F.col("a") + F.col("b") + F.col("c")) * F.when(F.col("o_custkey") % 10 == 0, 1.05).otherwise(1.0)
    long = flows.select("o_custkey", F.explode(F.array(*(F.struct(F.lit(n).alias("concept"), v.alias("value")) for n, v in zip(quality.CASH_FLOW.concepts, (change, F.col("a"), F.col("b"), F.col("c")), strict=True)))).alias("p")).select("o_custkey", "p.*")
    wide = quality.pivot_concepts(long, ["o_custkey"], list(quality.CASH_FLOW.concepts), ["concept"])
    return quality.tally(quality.evaluate(wide, ["o_custkey"], [quality.CASH_FLOW])).select("rule", "checks", "violations")


_ROLLED = "select user_id, cast(date_trunc('{u}', ts) as date) as start, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, count(*) as volume from events group by 1, 2"


@query("opt_05_periods", " union all ".join(f"select '{u}' as period, user_id, start, open, high, low, close, volume, round(close / lag(close) over (partition by user_id order by start) - 1, 9) as change from ({_ROLLED.format(u=u)})" for u in ("week", "quarter")))
def opt_05_periods(spark, sf_dir):
    """Weekly and quarterly bars, each with the change from the one before."""
    rolled = [quality.roll_up(views.bars(spark, sf_dir), "user_id", u).withColumn("period", F.lit(u)) for u in ("week", "quarter")]
    before = F.lag("close").over(Window.partitionBy("period", "user_id").orderBy("start"))
    return rolled[0].union(rolled[1]).withColumn("change", F.round(fn.ratio(F.col("close"), before) - 1, 9)).select("period", "user_id", "start", "open", "high", "low", "close", "volume", "change")


@query("opt_05_volatility", f"select user_id, count(r) as returns, round(stddev_samp(r), 9) as volatility from (select user_id, close / lag(close) over (partition by user_id order by day) - 1 r from {BARS}) group by 1")
def opt_05_volatility(spark, sf_dir):
    """Volatility of each series' daily returns."""
    r = fn.ratio(F.col("close"), F.lag("close").over(Window.partitionBy("user_id").orderBy("day"))) - 1
    return views.bars(spark, sf_dir).select("user_id", r.alias("r")).groupBy("user_id").agg(F.count("r").alias("returns"), F.round(F.stddev_samp("r"), 9).alias("volatility"))


_CRISES = [("1994-01-01", "1994-06-30"), ("1996-03-01", "1996-08-31")]


@query("opt_08_crisis", f"select case when {' or '.join(f"cast(l_shipdate as date) between date '{a}' and date '{b}'" for a, b in _CRISES)} then 'held_out' else 'train' end as split, least(floor(l_discount * 100), 9)::integer as bin, count(*) as n, round(avg((l_returnflag = 'R')::integer), 6) as observed from lineitem group by 1, 2")
def opt_08_crisis(spark, sf_dir):
    """Calibration inside held-out crisis windows and outside."""
    day = F.to_date("l_shipdate")
    inside = F.exists(F.array(*(F.struct(F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for a, b in _CRISES)), lambda w: day.between(w["a"], w["b"]))
    b = F.least(F.floor(F.col("l_discount") * 100), F.lit(9)).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(F.when(inside, "held_out").otherwise("train").alias("split"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("observed"))


# --- the filings stream with its amendments


@query("str_03_amendments", f"with x as (select distinct insider, period, accession, availability_date, shares, amended, l_linenumber from {_AMEND}), s as (select *, (select min(a.availability_date) from x a where a.amended and a.insider = o.insider and a.period = o.period and a.accession <> o.accession and a.availability_date > o.availability_date) r from x o) select availability_date as day, count(*) as filings, sum(amended::bigint)::bigint as amendments, sum((not amended and r is not null)::bigint)::bigint as superseded from s group by 1")
def str_03_amendments(spark, sf_dir):
    """Filings streamed into a table, the amendments swept once the stream has ended, and each day's status."""
    stream = jobs.follow(spark, f"{sf_dir}/lineitem*.parquet", spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema)
    keys = ["insider", "period", "accession", "availability_date", "shares", "amended", "l_linenumber"]

    def rows(batch):
        day = F.to_date("l_shipdate")
        return batch.select(fn.entity_id_from_cik(F.col("l_suppkey")).alias("entity_id"), day.alias("effective_date"), F.col("l_orderkey").cast("string").alias("source_ref"), F.col("l_suppkey").alias("insider"), F.col("l_orderkey").alias("period"), F.col("l_partkey").alias("accession"), day.alias("availability_date"), F.col("l_quantity").alias("shares"), (F.col("l_returnflag") == "R").alias("amended"), "l_linenumber", F.lit(None).cast("date").alias("restated_at"))

    path = scratch.folder(spark, "filings")
    jobs.merge_into(stream, path, scratch.folder(spark, "offsets"), rows)
    return jobs.daily_status(jobs.sweep_amendments(tables.read(spark, path, keys), ["insider", "period"]))
