"""Bulk loaders: landed files or text columns to canonical rows."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn

#: Documents of these types hold structured data and are left to their own loaders.
STRUCTURED_TYPES = ["XML", "EX-101.INS", "EX-101.SCH", "EX-101.CAL", "EX-101.DEF", "EX-101.LAB", "EX-101.PRE", "ZIP", "GRAPHIC", "JSON", "EXCEL"]


def quarters(spark: SparkSession, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """(year, quarter) from start to end, both included."""
    n = F.explode(F.sequence(F.lit(start[0] * 4 + start[1] - 1), F.lit(end[0] * 4 + end[1] - 1)))
    return spark.range(1).select(n.alias("n")).select(F.floor(F.col("n") / 4).cast("int").alias("year"), (F.col("n") % 4 + 1).cast("int").alias("quarter"))


def read_tsv(spark: SparkSession, paths: list[str], columns: str) -> DataFrame:
    """Tab-separated text with a header, by name; files that are missing are skipped."""
    return spark.read.option("ignoreMissingFiles", "true").csv(paths, sep="\t", header=True, schema=columns, enforceSchema=False, quote="")


def statement_facts(num: DataFrame, sub: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Statement values joined with their submissions: canonical financial facts.

    num: adsh, tag, version, ddate, qtrs, uom, segments, value; sub: adsh, cik, form, fy, fp, filed.  `keep` (cik) limits
    filers before the join.  Rows whose dates or value fail are dropped."""
    s = sub.withColumn("__cik", F.col("cik").try_cast("bigint"))
    if keep is not None:
        s = s.join(keep.select(F.col("cik").try_cast("bigint").alias("__cik")).distinct(), "__cik", "left_semi")
    s = s.select("adsh", "__cik", "form", F.col("fy").try_cast("int").alias("fiscal_year"), F.col("fp").alias("fiscal_period"), fn.compact_date(F.col("filed")).alias("availability_date"))
    end = fn.compact_date(F.col("ddate"))
    months = F.col("qtrs").try_cast("int") * 3
    rows = num.join(s, "adsh").select(
        fn.entity_id_from_cik(F.col("__cik")).alias("entity_id"), F.lit("financials").alias("modality"), end.alias("effective_date"), "availability_date", F.lit(None).cast("date").alias("restated_at"), F.lit("bulk_statements").alias("source"), F.col("adsh").alias("source_ref"),
        fn.concept_name(F.col("tag"), F.col("version")).alias("concept"), F.when(F.contains(F.col("version"), F.lit("/")), F.split_part(F.col("version"), F.lit("/"), F.lit(1))).otherwise("custom").alias("taxonomy"),
        F.when(months > 0, F.date_add(F.add_months(end, -months), 1)).alias("period_start"), end.alias("period_end"), "fiscal_year", "fiscal_period", F.col("uom").alias("unit"), F.col("value").try_cast("double").alias("value"), "form", F.col("adsh").alias("accession"), F.lit("").alias("context_id"), fn.segments_json(F.col("segments")).alias("dimensions_json"),
    )
    return rows.filter("effective_date is not null and availability_date is not null and value is not null")


NESTED_FACTS = "map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>>>>>>"


def nested_facts(companies: DataFrame) -> DataFrame:
    """(cik, facts JSON) to one row for each observation; rows without end, filed, fy or fp are dropped."""
    tax = companies.select("cik", F.explode(F.from_json("facts", NESTED_FACTS)).alias("taxonomy", "concepts"))
    con = tax.select("cik", "taxonomy", F.explode("concepts").alias("tag", "c"))
    unit = con.select("cik", "taxonomy", "tag", F.explode("c.units").alias("unit", "rows"))
    obs = unit.select("cik", "taxonomy", "tag", "unit", F.explode("rows").alias("o"))
    out = obs.select(fn.entity_id_from_cik(F.col("cik")).alias("entity_id"), F.concat_ws(":", "taxonomy", "tag").alias("concept"), "taxonomy", "unit", fn.iso_date(F.col("o.start")).alias("period_start"), fn.iso_date(F.col("o.end")).alias("effective_date"), fn.iso_date(F.col("o.filed")).alias("availability_date"), F.col("o.val").alias("value"), F.col("o.accn").alias("source_ref"), F.col("o.fy").alias("fiscal_year"), F.col("o.fp").alias("fiscal_period"), F.col("o.form").alias("form"))
    return out.dropna(subset=["effective_date", "availability_date", "fiscal_year", "fiscal_period"])


SUBMISSIONS = "struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>"


def submission_index(companies: DataFrame, forms: list[str] | None = None) -> DataFrame:
    """(cik, recent JSON of parallel arrays) to one row for each filing; the report date falls back on the filing date."""
    r = F.from_json("recent", SUBMISSIONS)
    zipped = F.arrays_zip(r["accessionNumber"].alias("accession"), r["form"].alias("form"), r["filingDate"].alias("filing_date"), r["reportDate"].alias("report_date"), r["primaryDocument"].alias("document"))
    rows = companies.select("cik", F.explode(zipped).alias("z")).select("cik", "z.accession", "z.form", fn.iso_date(F.col("z.filing_date")).alias("filing_date"), fn.iso_date(F.col("z.report_date")).alias("report_date"), "z.document")
    rows = rows.withColumn("report_date", F.coalesce("report_date", "filing_date")).filter("filing_date is not null")
    return rows.filter(F.col("form").isin(forms)) if forms else rows


def form_matches(form: Column, wanted: list[str]) -> Column:
    """The form itself, or the form that it amends."""
    return form.isin(wanted) | F.regexp_replace(form, "/A$", "").isin(wanted)


def _tag(text: Column, tag: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)<{tag}>([^\r\n<]*)", 1)), F.lit(""))


def filing_documents(containers: DataFrame) -> DataFrame:
    """(content: text of one filing container) to one row for each unstructured document.

    Header tags give accession, form, dates and all filers; documents without a sequence count from 1 in order;
    containers without a filing date are dropped."""
    c = F.col("content")
    head = F.substring_index(c, "<DOCUMENT>", 1)
    base = containers.select(
        _tag(head, "ACCESSION-NUMBER").alias("accession"), _tag(head, "TYPE").alias("form"), fn.compact_date(_tag(head, "FILING-DATE")).alias("filed_date"), fn.compact_date(_tag(head, "PERIOD")).alias("period_of_report"),
        F.array_distinct(F.transform(F.regexp_extract_all(head, F.lit(r"(?im)<CIK>([^\r\n<]*)"), 1), lambda x: F.lpad(F.trim(x), 10, "0"))).alias("ciks"),
        F.posexplode(F.regexp_extract_all(c, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), 1)).alias("pos", "doc"),
    ).filter("filed_date is not null")
    d = F.col("doc")
    body = F.regexp_extract(d, r"(?is)<TEXT>\r?\n?(.*?)\r?\n?</TEXT>", 1)
    rows = base.select("accession", "form", "filed_date", F.year("filed_date").alias("year"), "period_of_report", F.element_at("ciks", 1).alias("cik"), F.to_json("ciks").alias("all_ciks_json"), "ciks", F.coalesce(_tag(d, "SEQUENCE").try_cast("int"), F.col("pos") + 1).alias("sequence"), _tag(d, "TYPE").alias("document_type"), F.coalesce(_tag(d, "FILENAME"), F.lit("")).alias("document_name"), body.alias("content_text"))
    kept = rows.filter(~F.coalesce(F.upper("document_type").isin(STRUCTURED_TYPES), F.lit(False)))
    return kept.withColumns({"mime_type": fn.mime_type(F.col("document_name")), "n_chars": F.length("content_text"), "sha256": fn.content_hash(F.col("content_text").cast("binary"))})


def of_filers(documents: DataFrame, keep: DataFrame) -> DataFrame:
    """Documents of which any filer is kept."""
    hit = documents.select("accession", F.explode("ciks").alias("cik")).join(keep.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik")).distinct(), "cik", "left_semi").select("accession").distinct()
    return documents.join(hit, "accession", "left_semi")


#: What is read of an ownership document: fields of the document, of its first owner, and of each transaction.
_DOCUMENT = {"form": ("documentType",), "period_of_report": ("periodOfReport",), "issuer": ("issuer", "issuerCik")}
_OWNER = {"owner": ("reportingOwnerId", "rptOwnerCik"), "insider_name": ("reportingOwnerId", "rptOwnerName")} | {n: ("reportingOwnerRelationship", t) for n, t in (("director", "isDirector"), ("officer", "isOfficer"), ("ten", "isTenPercentOwner"), ("officer_title", "officerTitle"))}
_AMOUNTS = "transactionAmounts"
_TXN = {
    "security_title": ("securityTitle",), "day": ("transactionDate",), "transaction_code": ("transactionCoding", "transactionCode"), "shares": (_AMOUNTS, "transactionShares"), "price": (_AMOUNTS, "transactionPricePerShare"), "acquired_disposed": (_AMOUNTS, "transactionAcquiredDisposedCode"),
    "post": ("postTransactionAmounts", "sharesOwnedFollowingTransaction"), "direct_or_indirect": ("ownershipNature", "directOrIndirectOwnership"), "exercise": ("conversionOrExercisePrice",), "expires": ("expirationDate",),
}
_TABLES = (("nonDerivativeTable", "nonDerivativeTransaction", False), ("derivativeTable", "derivativeTransaction", True))


def _children(element) -> dict:
    """Child elements by name, the last of equals, whatever their namespace."""
    return {c.tag.rpartition("}")[2]: c for c in element} if element is not None else {}


def _fields(element, paths: dict[str, tuple], wrapped: bool) -> list:
    """Trimmed texts at paths below an element; transactions wrap all values but their code in `value`."""
    known: dict = {"": _children(element)}
    out = []
    for path in paths.values():
        if len(path) == 2 and path[0] not in known:
            known[path[0]] = _children(known[""].get(path[0]))
        found = known[path[0] if len(path) == 2 else ""].get(path[-1])
        if wrapped and path[-1] != "transactionCode" and found is not None:
            found = _children(found).get("value")
        out.append(None if found is None else (found.text or "").strip())
    return out


#: Documents that one parser reads as children of a common root: a parser of its own costs more than a small document.
_TOGETHER = 128


def _ownership_document(content: str | None) -> str:
    """The ownership document in whatever wraps it, or nothing."""
    text = content or ""
    start, stop = text.find("<ownershipDocument"), text.find("</ownershipDocument>")
    if 0 <= start < stop:
        return text[start : stop + len("</ownershipDocument>")]
    found = re.search(r"(?is)<ownershipDocument.*?</ownershipDocument>", text)
    return found.group() if found else ""


def _parsed(documents: list[str]) -> list:
    """The root of each document, None for an empty or malformed one."""
    try:
        roots = list(ElementTree.fromstring(f"<all>{''.join(documents)}</all>"))
        if len(roots) == sum(map(bool, documents)):
            following = iter(roots)
            return [next(following) if d else None for d in documents]
    except (ElementTree.ParseError, ValueError):
        pass
    if len(documents) > 1:  # one is malformed, or holds more than itself
        half = len(documents) // 2
        return _parsed(documents[:half]) + _parsed(documents[half:])
    return [None]


def _ownership_rows(root) -> list[list]:
    """The transactions of one document in order, none if it is malformed: ordinal, whether derivative, and the fields."""
    if root is None:
        return []
    owner = next((c for c in root if c.tag.rpartition("}")[2] == "reportingOwner"), None)
    shared = _fields(root, _DOCUMENT, False) + _fields(owner, _OWNER, False)
    parts = _children(root)
    found = [(derivative, t) for table, name, derivative in _TABLES if table in parts for t in parts[table] if t.tag.rpartition("}")[2] == name]
    return [[i, derivative, *shared, *_fields(t, _TXN, True)] for i, (derivative, t) in enumerate(found)]


def ownership_trades(filings: DataFrame) -> DataFrame:
    """(accession, filed, content with an ownership XML document) to one row for each transaction.

    The XML is taken out of whatever wraps it; malformed XML gives no rows.  The first reporting owner counts.  Rows
    without title, date or shares are dropped; `transaction_index` numbers what a filing reports, derivatives last.
    Documents are parsed in map tasks, once each; dates, numbers and flags are then worked out by expressions."""
    names = [*_DOCUMENT, *_OWNER, *_TXN]
    kinds = [pa.int32(), pa.bool_()] + [pa.string()] * len(names)

    def run(batches):
        for batch in batches:
            places, rows = [], []
            documents = [_ownership_document(x) for x in batch.column("content").to_pylist()]
            for at in range(0, len(documents), _TOGETHER):
                for i, root in enumerate(_parsed(documents[at : at + _TOGETHER]), at):
                    found = _ownership_rows(root)
                    places += [i] * len(found)
                    rows += found
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            own = batch.select(["accession", "filed"]).take(pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["accession", "filed", "transaction_index", "is_derivative", *names])

    docs = filings.select("accession", "filed", "content")
    schema = ", ".join([f"{c} {dict(docs.dtypes)[c]}" for c in ("accession", "filed")] + ["transaction_index int, is_derivative boolean"] + [f"{n} string" for n in names])
    flag = lambda c: F.coalesce(F.lower(F.trim(c)).isin("1", "true"), F.lit(False)).alias(f"is_{c}")
    number = lambda c: F.col(c).try_cast("double")
    out = docs.mapInArrow(run, schema).select(
        fn.entity_id_from_cik(F.col("issuer")).alias("entity_id"), fn.iso_date(F.col("day")).alias("effective_date"), F.col("filed").alias("availability_date"), "accession", "form", fn.iso_date(F.col("period_of_report")).alias("period_of_report"),
        F.lpad(F.ltrim(F.col("owner"), F.lit("0")), 10, "0").alias("insider_cik"), "insider_name", flag("director"), flag("officer"), flag("ten").alias("is_ten_percent_owner"), F.coalesce("officer_title", F.lit("")).alias("officer_title"),
        "security_title", "is_derivative", "transaction_code", number("shares").alias("shares"), number("price").alias("price_per_share"), "acquired_disposed",
        number("post").alias("post_transaction_shares"), "direct_or_indirect", number("exercise").alias("exercise_price"), fn.iso_date(F.col("expires")).alias("expiration_date"), "transaction_index",
    )
    return out.filter("coalesce(security_title, '') <> '' and effective_date is not null and shares is not null")


#: Positions of the event feed's columns.
NEWS_COLUMNS = {"global_event_id": 0, "event_date": 1, "actor1_name": 6, "actor2_name": 16, "cameo_event_code": 26, "event_base_code": 27, "event_root_code": 28, "quad_class": 29, "n_mentions": 31, "avg_tone": 34, "goldstein_scale": 30, "indexed": 59}


def news_events(lines: DataFrame, columns: dict[str, int] = NEWS_COLUMNS, width: int = 60) -> DataFrame:
    """(value: tab-separated lines) to event rows; lines that are short, or lack an id or dates, are dropped."""
    f = F.split("value", "\t")
    at = lambda c: F.get(f, F.lit(columns[c]))
    number = lambda c, kind, default: F.coalesce(at(c).try_cast(kind), F.lit(default).cast(kind))
    rows = lines.filter(F.size(f) >= width).select(
        at("global_event_id").alias("global_event_id"), fn.compact_date(at("event_date")).alias("effective_date"), fn.compact_date(F.left(at("indexed"), F.lit(8))).alias("availability_date"), at("actor1_name").alias("actor1_name"), at("actor2_name").alias("actor2_name"), at("cameo_event_code").alias("cameo_event_code"), at("event_root_code").alias("event_root_code"),
        number("quad_class", "int", 0).alias("quad_class"), number("goldstein_scale", "double", 0.0).alias("goldstein_scale"), number("n_mentions", "int", 1).alias("n_mentions"), number("avg_tone", "double", 0.0).alias("avg_tone"),
    )
    return rows.filter("global_event_id <> '' and effective_date is not null and availability_date is not null")


def vintages(rows: DataFrame, start=None, end=None) -> DataFrame:
    """(series_id, release_date, observation_date, value) to canonical rows; nulls go, releases outside the window too."""
    r = rows.filter("value is not null")
    if start is not None:
        r = r.filter(F.col("release_date") >= F.lit(start).cast("date"))
    if end is not None:
        r = r.filter(F.col("release_date") <= F.lit(end).cast("date"))
    return r.select(F.concat(F.lit("fred:"), "series_id").alias("entity_id"), F.col("observation_date").alias("effective_date"), F.col("release_date").alias("availability_date"), F.concat_ws("@", "series_id", "release_date").alias("source_ref"), "series_id", "value")


def price_bars(rows: DataFrame, interval: str = "1d") -> DataFrame:
    """OHLCV rows with defaults: adjusted close is the close, a split of 0 is none, and the interval is named."""
    names = {"1d": "daily", "1wk": "weekly", "1mo": "monthly"}
    adj = F.coalesce(F.col("adj_close"), F.col("close")) if "adj_close" in rows.columns else F.col("close")
    split = F.coalesce(F.nullif(F.col("split_ratio"), F.lit(0.0)), F.lit(1.0)) if "split_ratio" in rows.columns else F.lit(1.0)
    dividend = F.coalesce(F.col("dividend"), F.lit(0.0)) if "dividend" in rows.columns else F.lit(0.0)
    return rows.withColumns({"adj_close": adj, "split_ratio": split, "dividend": dividend, "frequency": F.lit(names.get(interval, interval))})


LABOUR = "struct<Results:struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,value:string>>>>>>"


def labour_series(responses: DataFrame, series: DataFrame) -> DataFrame:
    """(body JSON) with a dimension (series_id, industry, measure) to monthly rows; only `Mnn` periods count."""
    s = responses.select(F.explode(F.from_json("body", LABOUR)["Results"]["series"]).alias("s")).select("s.seriesID", F.explode("s.data").alias("d"))
    month = F.substring("d.period", 2, 2).try_cast("int")
    end = F.last_day(F.make_date(F.col("d.year").cast("int"), month, F.lit(1)))
    rows = s.filter(F.col("d.period").rlike(r"^M(0[1-9]|1[0-2])$")).select(F.col("seriesID").alias("series_id"), end.alias("effective_date"), F.regexp_replace("d.value", ",", "").try_cast("double").alias("value"))
    return rows.filter("value is not null").join(series, "series_id").withColumn("availability_date", fn.labour_release(F.col("effective_date")))


PATENTS = "struct<patents:array<struct<patent_id:string,patent_number:string,patent_date:string,patent_title:string,patent_abstract:string,application:array<struct<filing_date:string>>,app_date:string,assignees:array<struct<assignee_organization:string>>,inventors:array<struct<inventor_name_first:string,inventor_name_last:string>>,cpc_current:array<struct<cpc_group_id:string>>,patent_num_claims:int>>>"


def patents(responses: DataFrame) -> DataFrame:
    """(body JSON) to one row for each patent; the application date falls back on the grant; names and classes as JSON lists."""
    p = responses.select(F.explode(F.from_json("body", PATENTS)["patents"]).alias("p")).select("p.*")
    grant = fn.iso_date(F.col("patent_date"))
    full = lambda i: F.trim(F.concat_ws(" ", i["inventor_name_first"], i["inventor_name_last"]))
    rows = p.select(
        F.coalesce("patent_number", "patent_id").alias("patent_number"), F.coalesce(fn.iso_date(F.get("application", F.lit(0))["filing_date"]), fn.iso_date(F.col("app_date")), grant).alias("application_date"), grant.alias("grant_date"), F.col("patent_title").alias("title"), F.coalesce("patent_abstract", F.lit("")).alias("abstract"), F.coalesce(F.get("assignees", F.lit(0))["assignee_organization"], F.lit("")).alias("assignee_name_as_filed"), F.coalesce("patent_num_claims", F.lit(0)).alias("claims_count"),
        F.to_json(F.filter(F.transform(F.coalesce("cpc_current", F.array().cast("array<struct<cpc_group_id:string>>")), lambda c: c["cpc_group_id"]), lambda c: c.isNotNull())).alias("cpc_classifications"), F.to_json(F.filter(F.transform(F.coalesce("inventors", F.array().cast("array<struct<inventor_name_first:string,inventor_name_last:string>>")), full), lambda n: n != "")).alias("inventors"),
    )
    return rows.filter("patent_number is not null and grant_date is not null")


def registry(tickers: DataFrame) -> DataFrame:
    """(pos, cik, ticker, name) to one row for each CIK: the shortest ticker, ties and the name by first position."""
    r = tickers.groupBy("cik").agg(F.min_by("ticker", F.struct(F.length("ticker"), "pos")).alias("ticker"), F.min_by("name", "pos").alias("name"))
    return r.select(fn.entity_id_from_cik(F.col("cik")).alias("entity_id"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), "ticker", "name")
