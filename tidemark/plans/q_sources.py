"""Queries of loaders and tables: landed forms are made from the star-schema tables by Spark, loaded, and compared with what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views import FACT_KEYS, FACTS, table
from tidemark.sources import loaders, tables

_D = "strftime({c}, '%Y%m%d')"


def _num_sub(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    version = F.when(F.col("l_linestatus") == "O", "us-gaap/2024").when(F.col("l_returnflag") == "N", F.lit(None)).otherwise("0000320193")
    num = l.select(F.col("l_orderkey").cast("string").alias("adsh"), F.concat(F.lit("Tag"), "l_returnflag").alias("tag"), version.alias("version"), F.date_format("l_shipdate", "yyyyMMdd").alias("ddate"), F.lit("1").alias("qtrs"), F.lit("USD").alias("uom"), F.when(F.col("l_linenumber") == 2, F.concat(F.lit("B=y;A="), "l_partkey", F.lit(";"))).alias("segments"), F.col("l_extendedprice").cast("string").alias("value"))
    sub = o.select(F.col("o_orderkey").cast("string").alias("adsh"), F.col("o_custkey").cast("string").alias("cik"), F.lit("10-Q").alias("form"), F.year("o_orderdate").cast("string").alias("fy"), F.lit("Q1").alias("fp"), F.date_format("o_orderdate", "yyyyMMdd").alias("filed"))
    return num, sub


@query("src_06", """select 'us-cik-' || lpad(o_custkey::varchar, 10, '0') as entity_id, l_orderkey::varchar as source_ref, cast(l_shipdate as date) as effective_date, cast(o_orderdate as date) as availability_date,
    case when l_linestatus = 'O' then 'us-gaap:Tag' || l_returnflag when l_returnflag = 'N' then 'custom:unknown' else 'custom:Tag' || l_returnflag end as concept, year(o_orderdate)::integer as fiscal_year, l_extendedprice as value,
    case when l_linenumber = 2 then '{"A":"' || l_partkey || '","B":"y"}' else '' end as dimensions_json from lineitem join orders on l_orderkey = o_orderkey""")
def src_06(spark, sf_dir):
    """Statement bulk files of all filers."""
    return loaders.statement_facts(*_num_sub(spark, sf_dir)).select("entity_id", "source_ref", "effective_date", "availability_date", "concept", "fiscal_year", "value", "dimensions_json")


@query("jn_01", "select l_orderkey::varchar as adsh, l_partkey, o_custkey as cik from lineitem join orders on l_orderkey = o_orderkey")
def jn_01(spark, sf_dir):
    """Facts with their submissions."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey")
    return l.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cik")), "k").select(F.col("k").cast("string").alias("adsh"), "l_partkey", "cik")


@query("jn_02", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def jn_02(spark, sf_dir):
    """Filings of registered filers, keys compared as numbers."""
    keep = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").try_cast("bigint").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(keep, "o_custkey", "left_semi").select("o_orderkey")


@query("jn_03", "select e.user_id, c.c_name as name, 'us-cik-' || lpad(c.c_custkey::varchar, 10, '0') as entity_id from (select distinct user_id from events) e left join customer c on c.c_custkey = e.user_id")
def jn_03(spark, sf_dir):
    """Registry lookup by number."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    reg = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), fn.entity_id_from_cik(F.col("c_custkey")).alias("entity_id"))
    return users.join(reg, "user_id", "left")


@query("jn_04", "select event_id, coalesce('us-cik-' || lpad(a.c_custkey::varchar, 10, '0'), 'us-cik-' || lpad(b.c_custkey::varchar, 10, '0'), 'unresolved:' || left(a1, 32)) as entity_id from (select event_id, 'CUSTOMER#' || lpad((user_id * 97)::varchar, 9, '0') a1, 'CUSTOMER#' || lpad((user_id + 1)::varchar, 9, '0') a2 from events) e left join customer a on upper(a.c_name) = a1 left join customer b on upper(b.c_name) = a2")
def jn_04(spark, sf_dir):
    """News attributed to the first actor that the registry knows."""
    from tidemark.operators import resolve

    named = lambda k: F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    news = table(spark, sf_dir, "events").select("event_id", named(F.col("user_id") * 97).alias("actor1_name"), named(F.col("user_id") + 1).alias("actor2_name"))
    reg = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), fn.entity_id_from_cik(F.col("c_custkey")).alias("entity_id"), F.col("c_custkey").alias("pos"))
    return resolve.attribute_news(news, reg).select("event_id", "entity_id")


@query("jn_10", "select event_id, case event_type when 'click' then 'C' when 'view' then 'V' else 'O' end as code from events where event_type in ('click', 'view')")
def jn_10(spark, sf_dir):
    """Series ids with their metadata."""
    dim = spark.range(1).select(F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(a), F.lit(b)) for a, b in (("click", "C"), ("view", "V")))))).alias("event_type", "code"))
    return table(spark, sf_dir, "events").join(F.broadcast(dim), "event_type").select("event_id", "code")


@query("src_07", "select y::integer as year, q::integer as quarter from (select unnest(range(1992, 1999)) y), (select unnest([1, 2, 3, 4]) q), (select min(year(o_orderdate)) a from orders) where y * 4 + q between a * 4 + 2 and (a + 3) * 4 + 3")
def src_07(spark, sf_dir):
    """Quarters from the second of the first order year to the third three years on."""
    a = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate"))).first()[0]
    return loaders.quarters(spark, (a, 2), (a + 3, 3))


@query("src_08", f"select entity_id, concept, effective_date, availability_date, value, source_ref, fiscal_year, fiscal_period from {FACTS} where fiscal_year is not null")
def src_08(spark, sf_dir):
    """Nested company facts, flattened."""
    f = views.facts(spark, sf_dir)
    obs = F.struct(F.col("effective_date").cast("string").alias("end"), F.col("value").alias("val"), F.col("source_ref").alias("accn"), F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"), F.lit("10-Q").alias("form"), F.col("availability_date").cast("string").alias("filed"))
    units = f.groupBy("entity_id", F.substring_index("concept", ":", -1).alias("tag")).agg(F.collect_list(obs).alias("rows"))
    tags = units.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct(F.create_map(F.lit("USD"), "rows").alias("units"))))).alias("tags"))
    landed = tags.select(F.substring_index("entity_id", "-", -1).alias("cik"), F.to_json(F.create_map(F.lit("us-gaap"), "tags")).alias("facts"))
    return loaders.nested_facts(landed).select("entity_id", "concept", "effective_date", "availability_date", "value", "source_ref", "fiscal_year", "fiscal_period")


@query("src_09", "select o_custkey as cik, o_orderkey::varchar as accession, case when o_orderstatus = 'F' then '10-K' else '10-Q' end as form, cast(o_orderdate as date) as filing_date, cast(o_orderdate as date) - (case when o_orderkey % 2 = 0 then 5 else 0 end)::integer as report_date from orders where o_orderstatus in ('F', 'O')")
def src_09(spark, sf_dir):
    """Parallel arrays to filings, by form."""
    o = table(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    row = F.struct(F.col("o_orderkey").cast("string").alias("a"), form.alias("f"), F.to_date("o_orderdate").cast("string").alias("d"), F.when(F.col("o_orderkey") % 2 == 0, F.date_sub(F.to_date("o_orderdate"), 5).cast("string")).otherwise("").alias("r"))
    each = o.groupBy("o_custkey").agg(F.collect_list(row).alias("x"))
    take = lambda k: F.transform("x", lambda s: s[k])
    recent = F.to_json(F.struct(take("a").alias("accessionNumber"), take("f").alias("form"), take("d").alias("filingDate"), take("r").alias("reportDate"), F.transform("x", lambda s: F.concat(s["a"], F.lit(".htm"))).alias("primaryDocument")))
    return loaders.submission_index(each.select(F.col("o_custkey").alias("cik"), recent.alias("recent")), ["10-K", "10-Q"]).select("cik", "accession", "form", "filing_date", "report_date")


def _containers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    head = F.concat(F.lit("<SUBMISSION>\n<ACCESSION-NUMBER>A-"), "doc_id", F.lit("\n<TYPE>10-K\n<FILING-DATE>20240"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("15\n<PERIOD>20231231\n<FILER>\n<CIK>"), (F.col("doc_id") % 50).cast("string"), F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, F.lit("<CIK>77\n")).otherwise(""))
    one = F.concat(F.lit("<DOCUMENT>\n<TYPE>10-K\n<SEQUENCE>1\n<FILENAME>main.htm\n<TEXT>\n"), "text", F.lit("\n</TEXT>\n</DOCUMENT>\n"))
    two = F.lit("<DOCUMENT>\n<TYPE>EX-99\n<FILENAME>note.txt\n<TEXT>\nnote\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-101.INS\n<FILENAME>x.xml\n<TEXT>\n<x/>\n</TEXT>\n</DOCUMENT>\n")
    return d.select(F.concat(head, one, two).alias("content"))


_DOCS = "(select 'A-' || doc_id as accession, 1 as sequence, 'main.htm' as document_name, 'text/html' as mime_type, sha256(text) as sha256, doc_id from documents where text is not null union all select 'A-' || doc_id, 2, 'note.txt', 'text/plain', sha256('note'), doc_id from documents where text is not null)"


@query("src_10", f"select accession, sequence, document_name, mime_type, sha256, make_date(2024, (doc_id % 9 + 1)::integer, 15) as filed_date from {_DOCS}")
def src_10(spark, sf_dir):
    """Filing containers to documents."""
    return loaders.filing_documents(_containers(spark, sf_dir)).select("accession", "sequence", "document_name", "mime_type", "sha256", "filed_date")


@query("flt_04", f"select accession, document_name from {_DOCS} where doc_id % 50 = 7 or doc_id % 3 = 0")
def flt_04(spark, sf_dir):
    """Documents of which any filer is wanted."""
    keep = table(spark, sf_dir, "nation").filter("n_nationkey in (7)").select(F.col("n_nationkey").alias("cik"))
    return loaders.of_filers(loaders.filing_documents(_containers(spark, sf_dir)), keep.union(keep.select(F.lit(77)))).select("accession", "document_name")


@query("flt_06", f"select mime_type, count(*) as n from {_DOCS} group by 1")
def flt_06(spark, sf_dir):
    """Unstructured documents by kind."""
    return loaders.filing_documents(_containers(spark, sf_dir)).groupBy("mime_type").agg(F.count(F.lit(1)).alias("n"))


@query("src_11", f"select count(*) as n, count(distinct accession) as accessions from {_DOCS}")
def src_11(spark, sf_dir):
    """A document store merged with a batch that it holds in part already."""
    d = loaders.filing_documents(_containers(spark, sf_dir)).select("accession", "document_name", "sha256")
    return tables.merge_documents(d.filter("document_name = 'main.htm'"), d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("accession").alias("accessions"))


@query("flt_05", "select o_orderkey, form from (select o_orderkey, case o_orderstatus when 'F' then '10-K/A' when 'O' then '10-K' else '8-K' end as form from orders) where form in ('10-K', '10-K/A')")
def flt_05(spark, sf_dir):
    """A form and its amendments."""
    form = F.when(F.col("o_orderstatus") == "F", "10-K/A").when(F.col("o_orderstatus") == "O", "10-K").otherwise("8-K")
    return table(spark, sf_dir, "orders").select("o_orderkey", form.alias("form")).filter(loaders.form_matches(F.col("form"), ["10-K"]))


@query("src_12", """select l_orderkey::varchar as accession, 'us-cik-' || lpad(l_suppkey::varchar, 10, '0') as entity_id, lpad(l_suppkey::varchar, 10, '0') as insider_cik, cast(l_shipdate as date) as effective_date, l_quantity as shares, l_extendedprice as price_per_share, l_returnflag as transaction_code, (l_linestatus = 'O') as is_derivative, count(*) as n from lineitem group by all""")
def src_12(spark, sf_dir):
    """Ownership documents: one with a transaction for each line item."""
    l = table(spark, sf_dir, "lineitem")
    value = lambda tag, c: F.concat(F.lit(f"<{tag}><value>"), c.cast("string"), F.lit(f"</value></{tag}>"))
    txn = F.concat(value("securityTitle", F.lit("Common")), value("transactionDate", F.to_date("l_shipdate")), F.lit("<transactionCoding><transactionCode>"), "l_returnflag", F.lit("</transactionCode></transactionCoding><transactionAmounts>"), value("transactionShares", F.col("l_quantity")), value("transactionPricePerShare", F.col("l_extendedprice")), F.lit("</transactionAmounts>"))
    table_of = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("<derivativeTable><derivativeTransaction>"), txn, F.lit("</derivativeTransaction></derivativeTable>"))).otherwise(F.concat(F.lit("<nonDerivativeTable><nonDerivativeTransaction>"), txn, F.lit("</nonDerivativeTransaction></nonDerivativeTable>")))
    xml = F.concat(F.lit("<XML>\n<ownershipDocument><documentType>4</documentType><periodOfReport>1998-01-01</periodOfReport><issuer><issuerCik>"), F.col("l_suppkey").cast("string"), F.lit("</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>"), F.col("l_suppkey").cast("string"), F.lit("</rptOwnerCik><rptOwnerName>X</rptOwnerName></reportingOwnerId></reportingOwner>"), table_of, F.lit("</ownershipDocument>\n</XML>"))
    t = loaders.ownership_trades(l.select(F.col("l_orderkey").cast("string").alias("accession"), F.to_date("l_shipdate").alias("filed"), xml.alias("content")))
    by = ["accession", "entity_id", "insider_cik", "effective_date", "shares", "price_per_share", "transaction_code", "is_derivative"]
    return t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@query("src_14", "select event_id::varchar as global_event_id, cast(ts as date) as effective_date, cast(ts as date) as availability_date, event_type as cameo_event_code, (user_id % 4)::integer as quad_class, value as goldstein_scale, 1 as n_mentions from events where user_id % 7 <> 0")
def src_14(spark, sf_dir):
    """Tab-separated news: short lines dropped, defaults filled."""
    day = F.date_format("ts", "yyyyMMdd")
    known = {0: F.col("event_id").cast("string"), 1: day, 6: F.lit("A"), 26: F.col("event_type"), 29: (F.col("user_id") % 4).cast("string"), 30: F.col("value").cast("string"), 59: F.concat(day, F.lit("001500"))}
    fields = [known.get(i, F.lit("")) for i in range(61)]
    line = F.when(F.col("user_id") % 7 == 0, F.concat_ws("\t", *fields[:40])).otherwise(F.concat_ws("\t", *fields))
    return loaders.news_events(table(spark, sf_dir, "events").select(line.alias("value"))).select("global_event_id", "effective_date", "availability_date", "cameo_event_code", "quad_class", "goldstein_scale", "n_mentions")


@query("src_15", "select 'fred:' || o_orderpriority as entity_id, cast(o_orderdate as date) as availability_date, o_orderpriority || '@' || cast(o_orderdate as date) as source_ref, o_totalprice as value from orders where o_orderstatus <> 'P' and cast(o_orderdate as date) between date '1995-01-01' and date '1996-12-31'")
def src_15(spark, sf_dir):
    """Vintages in a window of releases."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("release_date"), F.to_date(F.trunc("o_orderdate", "month")).alias("observation_date"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"))
    return loaders.vintages(rows, "1995-01-01", "1996-12-31").select("entity_id", "availability_date", "source_ref", "value")


@query("flt_11", "select count(*) as n from orders where o_orderstatus <> 'P' and cast(o_orderdate as date) between date '1995-01-01' and date '1996-12-31'")
def flt_11(spark, sf_dir):
    """How many vintages the window leaves."""
    return src_15(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query("src_16", f"select user_id, day, close, close as adj_close, 1.0::double as split_ratio, 'daily' as frequency from {views.BARS}")
def src_16(spark, sf_dir):
    """Price bars with their defaults."""
    b = views.bars(spark, sf_dir).withColumn("split_ratio", F.lit(0.0))
    return loaders.price_bars(b).select("user_id", "day", "close", "adj_close", "split_ratio", "frequency")


@query("src_17", "select 'JTS' || rpad(o_custkey::varchar, 6, '0') || '000000000JOL' as series_id, last_day(cast(o_orderdate as date)) as effective_date, round(o_totalprice, 2) as value, cast(date_trunc('week', last_day(cast(o_orderdate as date)) + 47) as date) + 1 as availability_date from orders where o_orderkey % 5 <> 0")
def src_17(spark, sf_dir):
    """Labour series in JSON: annual averages dropped, separators stripped, released on a Tuesday."""
    o = table(spark, sf_dir, "orders")
    sid = fn.labour_series_id(F.col("o_custkey").cast("string"), F.lit("JOL"))
    period = F.when(F.col("o_orderkey") % 5 == 0, "M13").otherwise(F.date_format("o_orderdate", "'M'MM"))
    point = F.struct(F.year("o_orderdate").cast("string").alias("year"), period.alias("period"), F.format_number("o_totalprice", 2).alias("value"))
    series = o.groupBy(sid.alias("seriesID")).agg(F.collect_list(point).alias("data"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct("seriesID", "data")).alias("series")).alias("Results")))
    dim = series.select(F.col("seriesID").alias("series_id"))
    return loaders.labour_series(series.select(body.alias("body")), dim).select("series_id", "effective_date", "value", "availability_date")


@query("fn_27", "select 'JTS' || rpad(o_custkey::varchar, 6, '0') || '000000000JOL' as series_id, count(*) as n from orders group by 1")
def fn_27(spark, sf_dir):
    """Series ids."""
    return table(spark, sf_dir, "orders").groupBy(fn.labour_series_id(F.col("o_custkey").cast("string"), F.lit("JOL")).alias("series_id")).agg(F.count(F.lit(1)).alias("n"))


@query("src_18", "select p_partkey::varchar as patent_number, date '2024-01-16' as grant_date, case when p_partkey % 2 = 0 then date '2022-05-01' else date '2024-01-16' end as application_date, p_name as title, '[\"' || p_type || '\"]' as cpc_classifications, '[\"Ada ' || p_brand || '\"]' as inventors from part where p_size > 5")
def src_18(spark, sf_dir):
    """Patents in JSON; those without grant date go."""
    p = table(spark, sf_dir, "part")
    rec = F.struct(F.col("p_partkey").cast("string").alias("patent_id"), F.when(F.col("p_size") > 5, "2024-01-16").alias("patent_date"), F.col("p_name").alias("patent_title"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.struct(F.lit("2022-05-01").alias("filing_date")))).alias("application"), F.array(F.struct(F.col("p_type").alias("cpc_group_id"))).alias("cpc_current"), F.array(F.struct(F.lit("Ada").alias("inventor_name_first"), F.col("p_brand").alias("inventor_name_last"))).alias("inventors"))
    landed = p.select(F.to_json(F.struct(F.array(rec).alias("patents"))).alias("body"))
    return loaders.patents(landed).select("patent_number", "grant_date", "application_date", "title", "cpc_classifications", "inventors")


@query("fn_24", "select p_type as cpc, count(*) as n from part where p_size > 5 group by 1")
def fn_24(spark, sf_dir):
    """JSON lists decoded again."""
    return src_18(spark, sf_dir).select(F.explode(F.from_json("cpc_classifications", "array<string>")).alias("cpc")).groupBy("cpc").agg(F.count(F.lit(1)).alias("n"))


@query("src_19", "select 'us-cik-' || lpad(k::varchar, 10, '0') as entity_id, lpad(k::varchar, 10, '0') as cik, arg_min(t, (strlen(t), pos)) as ticker, arg_min(n, pos) as name from (select p_size k, p_brand t, p_name n, p_partkey pos from part) group by k")
def src_19(spark, sf_dir):
    """A registry from repeated listings: the shortest ticker, the first name."""
    p = table(spark, sf_dir, "part")
    return loaders.registry(p.select(F.col("p_partkey").alias("pos"), F.col("p_size").alias("cik"), F.col("p_brand").alias("ticker"), F.col("p_name").alias("name")))


_WRITES = f"(select *, 1 as batch, value as v from {FACTS} union all select *, 2, value * 2 from {FACTS} where fiscal_period = 'Q1')"


@query("src_04", f"select count(*) as n, round(sum(v), 2) as total from (select *, row_number() over (partition by entity_id, effective_date, source_ref, concept, fiscal_year, fiscal_period order by batch desc) rn from {_WRITES}) where rn = 1")
def src_04(spark, sf_dir):
    """A merge-write in which a second batch replaces the first quarters."""
    f = views.facts(spark, sf_dir)
    log = f.withColumn("batch", F.lit(1)).unionByName(f.filter("fiscal_period = 'Q1'").withColumns({"value": F.col("value") * 2, "batch": F.lit(2)}))
    return tables.merged(log, FACT_KEYS).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("set_01", f"select count(*) as n, sum((batch = 2)::bigint)::bigint as second from {_WRITES}")
def set_01(spark, sf_dir):
    """Existing rows and a new batch, united."""
    f = views.facts(spark, sf_dir)
    log = f.withColumn("batch", F.lit(1)).unionByName(f.filter("fiscal_period = 'Q1'").withColumn("batch", F.lit(2)), allowMissingColumns=True)
    return log.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("batch") == 2).cast("long")).alias("second"))


@query("src_02", "select count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem")
def src_02(spark, sf_dir):
    """Full scan."""
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("src_21", "select role, count(*) as arrivals, count(distinct text) as bodies from conversations group by 1")
def src_21(spark, sf_dir):
    """Content-addressed archive: arrivals against new bodies."""
    c = table(spark, sf_dir, "conversations").select("role", F.col("text").alias("body"))
    none = c.limit(0).select(F.lit("").alias("sha1"))
    _, log = tables.archive(c, none)
    return log.groupBy("role").agg(F.count(F.lit(1)).alias("arrivals"), F.count_distinct("sha1").alias("bodies"))


@query("src_22", "select a.event_id, a.event_type as name, round(epoch(b.ts) - epoch(a.ts), 3) as seconds from events a join events b on b.event_id = a.event_id + 1 where a.event_id % 2 = 0")
def src_22(spark, sf_dir):
    """Start and end events joined to durations."""
    e = table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    log = e.select("event_id", F.col("event_type").alias("name"), F.col("ts").alias("at"), F.when(even, "start").otherwise("end").alias("phase"), F.when(~even, F.col("event_id") - 1).alias("parent_id"))
    return tables.durations(log).select("event_id", "name", F.round("seconds", 3).alias("seconds"))


@query("dq_17", "select case when strlen(text) = 0 then 'ok_no_records' when strlen(text) > 400 then 'ok_with_records' else 'parse_failed' end as status, count(*) as n from conversations group by 1")
def dq_17(spark, sf_dir):
    """Parse results by status."""
    n = F.octet_length("text")
    s = F.when(n == 0, "ok_no_records").when(n > 400, "ok_with_records").otherwise("parse_failed")
    return table(spark, sf_dir, "conversations").groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_12", "select o_orderkey from orders join (select o_custkey k, max(o_orderdate) w from orders where o_orderdate < timestamp '1997-01-01' group by 1) on k = o_custkey where o_orderdate > w union select o_orderkey from orders where o_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1997-01-01')")
def flt_12(spark, sf_dir):
    """Filings newer than their filer's watermark."""
    o = table(spark, sf_dir, "orders")
    marks = o.filter("o_orderdate < timestamp '1997-01-01'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("watermark"))
    return tables.newer_than(o, marks, "o_custkey", "o_orderdate").select("o_orderkey")


@query("str_01", "select o_custkey, max(o_orderdate) as watermark, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_ref from orders group by 1")
def str_01(spark, sf_dir):
    """Watermarks after two loads."""
    o = table(spark, sf_dir, "orders")
    early = o.filter("o_orderdate < timestamp '1997-01-01'")
    empty = o.limit(0).select("o_custkey", F.col("o_orderdate").alias("watermark"), F.col("o_orderkey").alias("last_ref"))
    marks = tables.advance(empty, early, "o_custkey", "o_orderdate", "o_orderkey")
    return tables.advance(marks, tables.newer_than(o, marks, "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query("str_04", f"select user_id, count(*) as n from {views.BARS} where day > (select min(cast(ts as date)) + 10 from events) group by 1")
def str_04(spark, sf_dir):
    """Bars after each series' last stored one."""
    b = views.bars(spark, sf_dir)
    start = b.agg(F.min("day").alias("d")).select(F.date_add("d", 10).alias("watermark"))
    marks = b.select("user_id").distinct().crossJoin(F.broadcast(start))  # one date beside each series
    return tables.newer_than(b, marks, "user_id", "day").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("ver_03", "select user_id % 5 as modality, event_id as version, event_id % 90 as age_days, (row_number() over (partition by user_id % 5 order by event_id % 90, event_id desc) <= 3 or event_id % 90 < 30) as kept from events")
def ver_03(spark, sf_dir):
    """Retention of versions: the newest three, and the young."""
    v = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("modality"), F.col("event_id").alias("version"), (F.col("event_id") % 90).alias("age_days"))
    return tables.retained(v)


@query("opt_04", f"select f.entity_id, f.source_ref, m.mean from {FACTS} f asof join (select cast(o_orderdate as date) as d, round(avg(o_totalprice), 4) as mean from orders group by 1) m on f.availability_date >= m.d where f.fiscal_period = 'Q1'")
def opt_04(spark, sf_dir):
    """Macro context: the day's latest market mean beside each fact, by date alone."""
    from tidemark.operators import pit

    f = views.facts(spark, sf_dir).filter("fiscal_period = 'Q1'").select("entity_id", "source_ref", F.col("availability_date").alias("day"))
    # the market is one pseudo-entity with a version for each day: as many rows as the calendar has days
    m = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("availability_date")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    m = m.withColumns({"entity_id": F.lit("market"), "source_ref": F.lit(""), "restated_at": F.lit(None).cast("date")})
    days = pit.as_of_join(f.select(F.lit("market").alias("entity_id"), "day").distinct(), m, [], "day")
    return f.join(days.select("day", "mean"), "day").select("entity_id", "source_ref", "mean")


@query("fn_17", "select o_orderkey, cast(date_trunc('week', cast(o_orderdate as date) + 47) as date) + 1 as released from orders")
def fn_17(spark, sf_dir):
    """Release dates."""
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.labour_release(F.to_date("o_orderdate")).alias("released"))


@query("fn_20", "select l_orderkey, l_linenumber, round(sign(l_tax - l_discount) * ln(1 + abs((l_tax - l_discount) * 1000)) / 30, 9) as x from lineitem")
def fn_20(spark, sf_dir):
    """Signed logarithms."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(fn.signed_log((F.col("l_tax") - F.col("l_discount")) * 1000), 9).alias("x"))


@query("fn_03", "select p_partkey, upper(p_name) as name from part")
def fn_03(spark, sf_dir):
    """Names without punctuation and suffix words."""
    dressed = F.concat(F.lit("The "), "p_name", F.lit(", Inc."))
    return table(spark, sf_dir, "part").select("p_partkey", fn.normalise_name(dressed).alias("name"))


@query("fn_05", "select l_orderkey, l_linenumber, '{\"A\":\"' || l_partkey || '\",\"B\":\"y\"}' as j from lineitem")
def fn_05(spark, sf_dir):
    """Segments as sorted JSON, the last of equal keys."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.segments_json(F.concat(F.lit("B=x;B=y;A="), "l_partkey", F.lit(";"))).alias("j"))
