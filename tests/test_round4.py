"""Zero prices, streams of many keys, tagged documents and narrow shuffles against DuckDB and plain versions."""

import math
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators import pit, text
from tidemark.plans import catalog
from tidemark.sources import loaders, tables
from tidemark.streaming import newest


def rounded(rows):
    return sorted((tuple(repr(float(f"{v:.9g}")) if isinstance(v, float) else repr(v) for v in r) for r in rows))


@pytest.fixture(scope="module")
def zero_events(spark, data, tmp_path_factory):
    """Events of which some users close at zero: rises from it, stays at it, and one user with nothing else."""
    folder = tmp_path_factory.mktemp("zero")
    values = {1: [2.0, 0.0, 3.0, 1.5], 2: [0.0, 0.0, 5.0], 3: [4.0, 2.0, 2.0], 4: [0.0, 1.0], 5: [0.0], 6: [-0.0, 2.0, 3.0]}
    rows = [(u * 100 + i, datetime(2024, 1 + 3 * (i % 4), 3 + i), u, "click", v, "{}") for u, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"file://{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["opt_05_periods", "opt_05_volatility"])
def test_returns_over_a_close_of_zero(spark, zero_events, name):
    got = catalog.queries()[name](spark, f"file://{zero_events}")
    with duckdb.connect() as c:
        c.execute(f"create view events as select * from '{zero_events}/events.parquet/*.parquet'")
        cursor = c.execute(catalog.oracle_sql()[name])
        want = [dict(zip([d[0] for d in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    columns = sorted(got.columns)
    assert rounded([tuple(r[k] for k in columns) for r in want]) == rounded([tuple(r[k] for k in columns) for r in got.collect()])
    assert any(isinstance(v, float) and not math.isfinite(v) for r in want for v in r.values())


def test_ratio_is_that_of_floating_point(spark):
    pairs = [(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (1.0, 4.0), (None, 0.0), (1.0, None)]
    got = [r.x for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double").select("i", fn.ratio(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got[:3] == [math.inf, -math.inf, -math.inf] and math.isnan(got[3]) and got[4:] == [0.25, None, None]


def test_newest_wins_is_a_native_aggregate(spark, tmp_path):
    """Many keys cost no Python call each; nulls and NaN are the lowest order, also within a batch."""
    source, out, offsets = (f"file://{tmp_path}/{x}" for x in ("in", "out", "offsets"))
    at, nan = datetime(2024, 1, 5), math.nan
    rows = [("a", at, nan, "nan"), ("a", at, 1.0, "one"), ("b", at, None, "null"), ("b", datetime(2024, 1, 4), 9.0, "older"), ("c", None, 5.0, "no time")]
    spark.createDataFrame(rows, "k string, ts timestamp, n double, v string").coalesce(1).write.parquet(f"{source}/1")
    stream = spark.readStream.schema("k string, ts timestamp, n double, v string").parquet(f"{source}/*")
    winners = newest.newest_wins(stream, ["k"], "ts", ["n"], "30 days")
    assert winners.columns == stream.columns
    assert "Pandas" not in winners._jdf.queryExecution().analyzed().toString()
    newest.keep_newest(winners, out, offsets, ["k"])
    assert {r.k: r.v for r in newest.read_newest(spark, out, ["k"], "ts", ["n"]).collect()} == {"a": "one", "b": "null"}


def test_segments_are_split_once(spark):
    """The pairs are bound, not made again by each expression that names them, and the last of equal keys still wins."""
    frame = spark.createDataFrame([("B=x;A=1;B=y;B=z; A =2;C;D=",), ("a=1",), ("",), (None,), ("x;y",)], "s string").select(fn.segments_json(F.col("s")).alias("j"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.j for r in frame.collect()] == ['{"A":"2","B":"z","D":""}', '{"a":"1"}', "", "", ""]


TRADE = "<securityTitle><value> Common &amp; B </value><footnoteId id='F1'/></securityTitle><transactionDate><value>2024-03-05</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{n}</value></transactionShares><transactionPricePerShare><footnoteId id='F2'/></transactionPricePerShare></transactionAmounts>"
OWNED = "<ownershipDocument><!-- c --><documentType>4</documentType><issuer><issuerCik>12</issuerCik></issuer>{owners}<nonDerivativeTable>{plain}</nonDerivativeTable><derivativeTable>{derived}</derivativeTable></ownershipDocument>"
OWNERS = "".join(f"<reportingOwner><reportingOwnerId><rptOwnerCik>{c}</rptOwnerCik><rptOwnerName>{n}</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>{d}</isDirector></reportingOwnerRelationship></reportingOwner>" for c, n, d in (("0007", "First", "true"), ("8", "Second", "0")))


def test_ownership_documents_are_parsed_once(spark):
    """Each document meets one parser once; first owner, footnotes, bad numbers, order of both tables and malformed ones."""
    plain = "".join(f"<nonDerivativeTransaction>{TRADE.format(n=n)}</nonDerivativeTransaction>" for n in ("10.5", "none", "30"))
    derived = f"<derivativeTransaction>{TRADE.format(n=40)}</derivativeTransaction>"
    good = OWNED.format(owners=OWNERS, plain=plain, derived=derived)
    docs = [("a", f"<XML>\n{good}\n</XML>"), ("b", good.replace("</issuer>", "")), ("c", OWNED.format(owners="", plain="", derived=derived)), ("d", None), ("e", "<ownershipDocument/>")]
    trades = loaders.ownership_trades(spark.createDataFrame([(k, date(2024, 4, 1), x) for k, x in docs], "accession string, filed date, content string"))
    plan = trades._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "from_xml" not in plan
    got = sorted(tuple(r) for r in trades.select("accession", "transaction_index", "is_derivative", "entity_id", "insider_cik", "insider_name", "is_director", "is_officer", "officer_title", "security_title", "effective_date", "availability_date", "shares", "price_per_share", "transaction_code", "form").collect())
    row = lambda k, i, derivative, owner, shares: (k, i, derivative, "us-cik-0000000012", *owner, False, "", "Common & B", date(2024, 3, 5), date(2024, 4, 1), shares, None, "P", "4")
    first = ("0000000007", "First", True)
    assert got == [row("a", 0, False, first, 10.5), row("a", 2, False, first, 30.0), row("a", 3, True, first, 40.0), row("c", 0, True, (None, None, False), 40.0)]


def test_tagged_documents_read_alike_by_both_parsers():
    """Well-formed documents go by the XML parser, others by the HTML parser; where both can read, they agree."""
    page = '<html><body><xbrli:context id="c1"><xbrli:entity><xbrldi:explicitMember dimension="x:A">x:M</xbrldi:explicitMember></xbrli:entity><xbrli:instant>\n2024-03-05</xbrli:instant></xbrli:context><xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><p>It was <ix:nonFraction name="a:{n}" contextRef="c1" unitRef="u" scale="3">1,<b>2</b>34 &amp; </ix:nonFraction><ix:nonFraction name="nil" xsi:nil="true"/><IX:NONFRACTION NAME="a:B" contextRef="c1"/></p></body></html>'
    pages = [page.format(n="T"), page.format(n="T&nbsp;"), page.format(n="T").replace("</p>", ""), page.format(n="T").replace("<p>", "<!-- <ix:nonFraction> --><p>"), page.format(n="T").replace("<p>", "<script>'<b>'</script><p>"), "", "plain", page.format(n="T") * 2]
    calls = []
    whole = lambda p: (p.contexts, p.units, p.facts)
    for source in pages:
        other = text._Facts()
        other.feed(source)
        found = text._read_facts(source)
        calls.append(isinstance(found, text._Facts))
        assert whole(found) == whole(other)
    assert calls == [False, True, True, True, True, True, True, True]


@pytest.mark.parametrize(("name", "module", "function", "operator"), [("dq_16", tables, "append", "Join"), ("src_01", tables, "append", "Join"), ("str_06", pit, "as_of_join", "Window")])
def test_facts_that_are_read_again_are_stored(spark, data, monkeypatch, name, module, function, operator):
    """Appends do not join line items to orders again, and a refresh does not merge its log for each reader."""
    plans, original = [], getattr(module, function)

    def watched(*args):
        frame = args[1] if function == "as_of_join" else args[0]
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return original(*args)

    monkeypatch.setattr(module, function, watched)
    catalog.queries()[name](spark, data)
    assert len(plans) >= 2 and not [p for p in plans if operator in p]
