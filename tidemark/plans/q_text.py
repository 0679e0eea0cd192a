"""Queries of text, resolution, graph and streaming operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators import nearest, resolve, text
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views import EDGES, table
from tidemark.sources import scratch
from tidemark.streaming import jobs


@query("txt_01")
def txt_01(spark, sf_dir):
    """Pages as plain text."""
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


def _conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", F.concat(F.lit("Item "), (F.col("turn") + 1).cast("string"), F.lit(". "), "role", F.lit("\n"), "text").alias("t"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda s: s["t"]), "\n").alias("text"))


@query("txt_02", "select conv_id, (turn + 1)::varchar as item_id, role as item_title, strlen(text) as n_bytes from conversations where trim(text) <> ''")
def txt_02(spark, sf_dir):
    """Conversations as documents with item headings, cut into items."""
    return text.items(_conversations(spark, sf_dir), "conv_id").select("conv_id", "item_id", "item_title", F.octet_length("text").cast("long").alias("n_bytes"))


@query("win_05", "select conv_id, count(*) as items, max(strlen(text)) as longest from conversations where trim(text) <> '' group by 1")
def win_05(spark, sf_dir):
    """Items from heading to heading: how many, and the longest."""
    return txt_02(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("items"), F.max("n_bytes").alias("longest"))


def _chunk_sql(source: str, by: str, columns: str) -> str:
    """The chunks of `source` (by, text), walked from each chunk to the next: where one ends decides where the next begins."""
    size, back = text.CHUNK_CHARS, text.LOOK_BACK

    def stop(at: str) -> str:
        tail = f"substr(text, ({at}) + {size - back + 1}, {back})"
        space = f"({at}) + {size - back} + length(regexp_extract({tail}, '^(.*) [^ ]*$', 1, 's'))"
        return f"case when ({at}) + {size} >= length(text) then length(text) when contains({tail}, ' ') then {space} else ({at}) + {size} end"

    return f"""with recursive s as (select {by}, text, 0::bigint as pos, {stop('0::bigint')} as stop from {source} where text <> ''
        union all select {by}, text, next, {stop('next')} from (select *, greatest(stop - {text.OVERLAP_CHARS}, pos + 1) as next from s where stop < length(text))),
    c as (select {by}, pos, case when length(text) <= {size} then text else regexp_replace(substr(text, pos + 1, stop - pos), '^\\s+|\\s+$', '', 'g') end as text from s)
    select {by}, (row_number() over (partition by {by} order by pos) - 1)::integer as chunk_idx, (count(*) over (partition by {by}))::integer as n_chunks_in_item, {columns} from c where text <> ''"""


_CHUNK_SIZES = "length(text)::integer as n_chars, (length(text) // 4)::integer as n_tokens_approx"


@query("txt_03", _chunk_sql("documents", "doc_id", f"{_CHUNK_SIZES}, sha256(text) as sha256"))
def txt_03(spark, sf_dir):
    """Documents in overlapping chunks."""
    return text.chunk_rows(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "chunk_idx", "n_chunks_in_item", "n_chars", "n_tokens_approx", fn.content_hash(F.col("text").cast("binary")).alias("sha256"))


@query("txt_04", _chunk_sql("(select conv_id, (turn + 1)::varchar as item_id, trim(text) as text from conversations)", "conv_id, item_id", _CHUNK_SIZES))
def txt_04(spark, sf_dir):
    """Items of conversations in chunks."""
    return text.chunk_rows(text.items(_conversations(spark, sf_dir), "conv_id"), ["conv_id", "item_id"]).select("conv_id", "item_id", "chunk_idx", "n_chunks_in_item", "n_chars", "n_tokens_approx")


@query("win_04", "select conv_id, role, count(*) over (partition by conv_id, role) as n from conversations")
def win_04(spark, sf_dir):
    """Rows of each document and item."""
    return table(spark, sf_dir, "conversations").select("conv_id", "role", F.count(F.lit(1)).over(Window.partitionBy("conv_id", "role")).alias("n"))


@query("win_08", "select conv_id, role, turn from (select *, row_number() over (partition by conv_id, role order by turn) p from conversations) where p <= 3")
def win_08(spark, sf_dir):
    """The first three rows of each item."""
    return text.first_chunks(table(spark, sf_dir, "conversations").withColumnRenamed("turn", "chunk_idx"), ["conv_id", "role"]).select("conv_id", "role", F.col("chunk_idx").alias("turn"))


_CALLS = "(select doc_id, source as entity_id, text, case when doc_id % 3 = 0 then '8-K' else '10-K' end form, case when doc_id % 2 = 0 then '2.02' else '1A' end item_id from documents)"


@query("txt_05", f"select entity_id, doc_id::varchar as accession, sha256(text) as sha256, 'press_release' as coverage_class from {_CALLS} where form = '8-K' and item_id = '2.02' and text is not null")
def txt_05(spark, sf_dir):
    """Results announcements derived from filings' text."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    rows = d.select(F.col("source").alias("entity_id"), F.col("doc_id").cast("string").alias("accession"), F.when(F.col("doc_id") % 3 == 0, "8-K").otherwise("10-K").alias("form"), F.when(F.col("doc_id") % 2 == 0, "2.02").otherwise("1A").alias("item_id"), F.lit(0).alias("chunk_idx"), "text", F.length("text").alias("n_chars"), fn.approx_tokens(F.col("text")).alias("n_tokens_approx"))
    return text.earnings_excerpts(rows).select("entity_id", "accession", fn.content_hash(F.col("text").cast("binary")).alias("sha256"), "coverage_class")


@query("flt_10", f"select count(*) as n from {_CALLS} where form = '8-K' and item_id = '2.02' and text is not null")
def flt_10(spark, sf_dir):
    """How many there are."""
    return txt_05(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query("src_13", "select l_orderkey, 'us-gaap:Tag' || l_returnflag as concept, cast(l_shipdate as date) as period_end, case when l_linenumber = 2 then '{\"ProductAxis\":\"M' || l_partkey || '\"}' else '' end as dimensions_json, 'USD' as unit, case when l_linestatus = 'O' then -1 else 1 end * l_quantity * 1000 as value, count(*) as n from lineitem group by all")
def src_13(spark, sf_dir):
    """Inline-tagged documents, one for each line item, to numeric facts."""
    l = table(spark, sf_dir, "lineitem")
    member = F.when(F.col("l_linenumber") == 2, F.concat(F.lit('<xbrli:segment><xbrldi:explicitMember dimension="x:ProductAxis">x:M'), "l_partkey", F.lit("</xbrldi:explicitMember></xbrli:segment>"))).otherwise("")
    html = F.concat(F.lit('<html><body><ix:header><ix:resources><xbrli:context id="c1"><xbrli:entity>'), member, F.lit("</xbrli:entity><xbrli:period><xbrli:instant>"), F.to_date("l_shipdate").cast("string"), F.lit('</xbrli:instant></xbrli:period></xbrli:context><xbrli:unit id="u1"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit></ix:resources></ix:header><p>It was <ix:nonFraction name="us-gaap:Tag'), "l_returnflag", F.lit('" contextRef="c1" unitRef="u1" scale="3"'), F.when(F.col("l_linestatus") == "O", ' sign="-"').otherwise(""), F.lit(">"), F.format_number("l_quantity", 1), F.lit("</ix:nonFraction> then.</p></body></html>"))
    facts = text.inline_facts(l.select("l_orderkey", html.alias("html")), "l_orderkey")
    return facts.groupBy("l_orderkey", "concept", "period_end", "dimensions_json", "unit", "value").agg(F.count(F.lit(1)).alias("n"))


@query("fn_23", "select conv_id, count(*) as n from conversations where turn % 3 <> 2 group by 1")
def fn_23(spark, sf_dir):
    """Relations in responses with fences, prose and malformed ones."""
    edge = F.to_json(F.array(F.struct(F.concat(F.lit("T"), "turn").alias("target_name"), F.lit("SUPPLIER").alias("relationship_type"), F.lit("said so").alias("evidence_span"))))
    response = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here you are:\n```json\n"), edge, F.lit("\n```"))).when(F.col("turn") % 3 == 1, edge).otherwise("[not json")
    return table(spark, sf_dir, "conversations").select("conv_id", F.explode(fn.edges_from_response(response)).alias("e")).filter("e.relationship_type = 'supplier' and e.confidence = 0.5").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def _registry(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_name").alias("name"), F.concat(F.lit("TK"), F.col("p_partkey").cast("string")).alias("ticker"), fn.entity_id_from_cik(F.col("p_partkey")).alias("entity_id"), F.col("p_partkey").alias("pos"))


@query("grf_01", "select key, 'us-cik-' || lpad(min(pos)::varchar, 10, '0') as entity_id from (select upper(p_name) key, p_partkey pos from part union all select 'TK' || p_partkey, p_partkey from part) group by 1")
def grf_01(spark, sf_dir):
    """Resolver index of names and tickers, the first of equals."""
    return resolve.index(_registry(spark, sf_dir))


@query("grf_02", "select distinct p_name as name, 'us-cik-' || lpad((min(p_partkey) over (partition by p_name))::varchar, 10, '0') as entity_id, 100.0::double as score from part")
def grf_02(spark, sf_dir):
    """Names resolved exactly, in other dress."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("plain")).distinct().withColumn("name", F.concat(F.lit("The "), F.initcap("plain"), F.lit(" Inc.")))
    return resolve.resolve(names, resolve.index(_registry(spark, sf_dir))).select(F.col("plain").alias("name"), "entity_id", "score")


#: SQL of `resolve.token_set_score` over rows (a, b): the longest common subsequence by the zero bits of an integer, a bit a character.
_SCORES = """
sets as (select *, list_sort(list_distinct(string_split(a, ' '))) x, list_sort(list_distinct(string_split(b, ' '))) y from pairs),
parts as (select *, list_sort(list_intersect(x, y)) s from sets),
texts as (select *, array_to_string(s, ' ') shared, array_to_string(list_filter(x, lambda w: not list_contains(y, w)), ' ') only_x,
  array_to_string(list_filter(y, lambda w: not list_contains(x, w)), ' ') only_y from parts),
both_sides as (select *, trim(shared || ' ' || only_x) p, trim(shared || ' ' || only_y) q from texts),
masks as (select *, list_transform(string_split(q, ''), lambda c: list_sum(list_transform(range(0, length(p)),
  lambda i: case when substr(p, i::int + 1, 1) = c then 1::hugeint << i::int else 0::hugeint end))::hugeint) m, (1::hugeint << length(p)) - 1 every_bit from both_sides),
common as (select *, length(p) - bit_count(list_reduce(m, lambda held, c: (((held + (held & c)) | (held - (held & c))) & every_bit), every_bit)) lcs from masks),
scores as (select a, b, case when s <> [] and (only_x = '' or only_y = '') then 100.0::double else greatest(200.0::double * lcs / (length(p) + length(q)),
  case when s <> [] then 200.0::double * length(shared) / (length(shared) + length(p)) else 0 end,
  case when s <> [] then 200.0::double * length(shared) / (length(shared) + length(q)) else 0 end) end score from common)"""
_KEYS = "keys as (select b, min(pos) pos from (select upper(p_name) b, p_partkey pos from part union all select 'TK' || p_partkey, p_partkey from part) group by 1)"
_TYPOS = """names as (select plain, kind, case kind when 'end' then plain || 's' when 'front' then 'q' || substr(plain, 2) when 'inner' then left(plain, 2) || substr(plain, 4)
  when 'order' then split_part(plain, ' ', 2) || 'x ' || split_part(plain, ' ', 1) else 'zq ' || reverse(plain) end as name
  from (select distinct p_name plain from part), (select unnest(['end', 'front', 'inner', 'order', 'other']) kind))"""


@query("jn_05", f"""with {_KEYS}, {_TYPOS}, pairs as (select distinct upper(name) a, b from names, keys), {_SCORES},
  best as (select a, max(score) score, max_by(b, (score, b)) b from scores group by 1)
  select plain, kind, case when score >= 88 then 'us-cik-' || lpad(pos::varchar, 10, '0') else 'unresolved:' || name end as entity_id, round(score, 3) as score
  from names join best on a = upper(name) join keys using (b)""")
def jn_05(spark, sf_dir):
    """Names with an error at the end, the front or inside, with words in another order, or quite other ones, resolved by likeness to all keys."""
    kinds = F.explode(F.array(*map(F.lit, ("end", "front", "inner", "order", "other"))))
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("plain")).distinct().withColumn("kind", kinds)
    first, last = F.split_part("plain", F.lit(" "), F.lit(1)), F.split_part("plain", F.lit(" "), F.lit(2))
    typo = (
        F.when(F.col("kind") == "end", F.concat("plain", F.lit("s")))
        .when(F.col("kind") == "front", F.concat(F.lit("q"), F.expr("substr(plain, 2)")))
        .when(F.col("kind") == "inner", F.concat(F.expr("left(plain, 2)"), F.expr("substr(plain, 4)")))
        .when(F.col("kind") == "order", F.concat(last, F.lit("x "), first))
        .otherwise(F.concat(F.lit("zq "), F.reverse("plain")))
    )
    found = resolve.resolve(names.withColumn("name", typo), resolve.index(_registry(spark, sf_dir)))
    return found.select("plain", "kind", "entity_id", F.round("score", 3).alias("score"))


@query("agg_12", "select avg(case when user_id * 97 <= (select max(c_custkey) from customer) then 1 else 0 end) as rate from events")
def agg_12(spark, sf_dir):
    """Share of mentions that resolve."""
    named = F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 97).cast("string"), 9, "0"))
    reg = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), fn.entity_id_from_cik(F.col("c_custkey")).alias("entity_id"), F.col("c_custkey").alias("pos"))
    e = resolve.attribute_news(table(spark, sf_dir, "events").select("event_id", named.alias("actor1_name"), F.lit(None).cast("string").alias("actor2_name")), reg)
    return e.agg(F.avg(F.when(F.col("entity_id").startswith("unresolved:"), 0).otherwise(1)).alias("rate"))


@query("grf_03", """with keys as (select upper(p_name) b, min(p_partkey) pos from part group by 1)
    select 'us-cik-' || lpad(p_size::varchar, 10, '0') as entity_id, p_partkey::varchar as accession, 'us-cik-' || lpad(pos::varchar, 10, '0') as target_entity_id,
    'customer' as relationship_type, sha256(p_type) as evidence_hash, 0.9::double as confidence, p_partkey || '#1A' as source_ref from part join keys on b = upper(p_name)""")
def grf_03(spark, sf_dir):
    """Relations extracted from responses, resolved and hashed."""
    p = table(spark, sf_dir, "part")
    body = F.to_json(F.array(F.struct(F.initcap("p_name").alias("target_name"), F.lit("Customer").alias("relationship_type"), F.col("p_type").alias("evidence_span"), F.lit(0.9).alias("confidence"))))
    r = p.select(fn.entity_id_from_cik(F.col("p_size")).alias("entity_id"), F.col("p_partkey").cast("string").alias("accession"), F.lit("1A").alias("item_id"), F.lit("2024-01-01").cast("date").alias("effective_date"), F.lit("2024-02-01").cast("date").alias("availability_date"), F.concat(F.lit("Found: "), body).alias("response"))
    return resolve.edges(r, resolve.index(_registry(spark, sf_dir))).select("entity_id", "accession", "target_entity_id", "relationship_type", "evidence_hash", "confidence", "source_ref")


_ENDS = "(select last_day(cast(q as date) + interval 2 month) t from unnest(generate_series(date '1996-01-01', date '1996-12-31', interval 3 month)) u(q))"


@query("grf_04", f"select year(t) || '-Q' || quarter(t) as quarter, count(distinct (entity_id, target_entity_id, relationship_type)) as n from {EDGES} e, {_ENDS} where availability_date <= t group by 1")
def grf_04(spark, sf_dir):
    """Quarterly graphs, one relation for each source, target and kind."""
    ends = table(spark, sf_dir, "region").limit(1).select(F.explode(fn.period_ends(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"), 3)).alias("t"))
    rel = views.edges(spark, sf_dir).withColumn("restated_at", F.lit(None).cast("date"))
    return resolve.quarterly_graph(rel, ends).groupBy("quarter").agg(F.count(F.lit(1)).alias("n"))


@query("prj_01", f"select entity_id as src, target_entity_id as dst, relationship_type as kind from {EDGES}")
def prj_01(spark, sf_dir):
    """Relations as graph edges."""
    return views.edges(spark, sf_dir).select(F.col("entity_id").alias("src"), F.col("target_entity_id").alias("dst"), F.col("relationship_type").alias("kind"))


@query("opt_03", f"""with e as (select distinct entity_id src, target_entity_id dst from {EDGES}), h1 as (select distinct dst from e where src = 'us-cik-0000000001'), h2 as (select distinct e.dst from e join h1 on e.src = h1.dst)
    select node, max(risk) as risk from (select 'us-cik-0000000001' node, 1.0::double risk union all select dst, 0.5 from h1 union all select dst, 0.25 from h2) group by 1""")
def opt_03(spark, sf_dir):
    """A shock to one supplier, two hops on."""
    e = views.edges(spark, sf_dir).select(F.col("entity_id").alias("src"), F.col("target_entity_id").alias("dst")).distinct()
    shock = e.filter("src = 'us-cik-0000000001'").limit(1).select(F.col("src").alias("node"), F.lit(1.0).alias("risk"))
    return resolve.propagate(e, shock, depth=2)


@query("opt_06", "select q, vec_id, round(c, 9) as cosine, place from (select q.vec_id q, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) c, (row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], v.embedding::double[]) desc, v.vec_id))::integer place from embeddings q join embeddings v on v.vec_id < q.vec_id where q.vec_id % 100 = 0) where place <= 5")
def opt_06(spark, sf_dir):
    """Nearest earlier analogues of every hundredth vector, by cosine, against all.

    Pivots' angles rule out cells of vectors that cannot hold one of the five."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = nearest.nearest_earlier(v.filter("vec_id % 100 = 0"), v, "vec_id", 5)  # the stated query set
    return near.select("q", "vec_id", F.round("cosine", 9).alias("cosine"), "place")


def _event_stream(spark, sf_dir):
    return jobs.follow(spark, f"{sf_dir}/events*.parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)


@query("str_02", "select event_type, count(distinct event_id) as n from events group by 1")
def str_02(spark, sf_dir):
    """News stream merged into a table."""
    path = scratch.folder(spark, "news")

    def rows(batch):
        return batch.select(F.concat(F.lit("user-"), "user_id").alias("entity_id"), F.to_date("ts").alias("effective_date"), F.to_date("ts").alias("availability_date"), F.col("event_id").cast("string").alias("source_ref"), "event_type")

    jobs.merge_into(_event_stream(spark, sf_dir), path, scratch.folder(spark, "offsets"), rows)
    from tidemark.sources import tables

    return tables.read(spark, path, ["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("str_03", "select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2")
def str_03(spark, sf_dir):
    """Daily loads by type from the stream, equal to the batch result."""
    out = scratch.folder(spark, "daily")
    rows = []

    def put(batch, number):
        batch.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.append(number)

    _event_stream(spark, sf_dir).writeStream.foreachBatch(put).option("checkpointLocation", scratch.folder(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("start", "event_type").agg(F.sum("n").alias("n"))
