"""Column expressions for identifiers, dates, names and numbers of filed data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in a company's name.
NAME_SUFFIXES = [
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "LLC", "LLP", "LP", "PLC", "AG", "SA", "NV",
    "GMBH", "PTE", "HOLDINGS", "GROUP", "INTERNATIONAL", "INTL", "THE", "PRECISION", "INDUSTRY", "INDUSTRIES",
]
FISCAL_ORDER = {"Q1": 1, "Q2": 2, "Q3": 3, "Q4": 4, "FY": 5, "Q": 1}
MIME_TYPES = [("html?", "text/html"), ("xml|xsd", "application/xml"), ("txt", "text/plain"), ("pdf", "application/pdf"), ("jpe?g", "image/jpeg"), ("png", "image/png"), ("gif", "image/gif"), ("xlsx?", "application/vnd.ms-excel")]


def entity_id_from_cik(cik: Column) -> Column:
    """`us-cik-` and ten digits."""
    return F.concat(F.lit("us-cik-"), F.lpad(F.ltrim(cik.cast("string"), F.lit("0")), 10, "0"))


def normalise_name(name: Column) -> Column:
    """Upper case, punctuation as spaces, without suffix words."""
    words = F.split(F.trim(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(NAME_SUFFIXES)), " ")


def unresolved(name: Column, length: int = 50) -> Column:
    """The placeholder id of a name that nothing resolves."""
    return F.concat(F.lit("unresolved:"), F.coalesce(F.nullif(F.substring(F.trim(name), 1, length), F.lit("")), F.lit("empty")))


def segments_json(segments: Column) -> Column:
    """`A=x;B=y;` as JSON with sorted keys, the last of equal keys; empty for none."""
    pairs = F.filter(F.split(F.coalesce(segments, F.lit("")), ";"), lambda p: F.contains(p, F.lit("=")))
    # sorted by key and place, so that the last of equal keys is the one before another key
    part = lambda p, i: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), i.alias("at"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value"))
    ordered = F.sort_array(F.transform(pairs, part))

    def text(found: Column) -> Column:
        last = F.filter(found, lambda p, i: ~F.coalesce(F.get(found, i + 1)["key"] == p["key"], F.lit(False)))
        return F.when(F.size(found) == 0, F.lit("")).otherwise(F.to_json(F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))))

    # the pairs are bound once: an expression that names them several times would make them as often
    return F.get(F.transform(F.array(ordered), text), F.lit(0))


def concept_name(tag: Column, version: Column) -> Column:
    """`taxonomy:tag`, the taxonomy being what stands before the version's slash; without slash the filer's own, `custom`."""
    named = F.when(version.isNull(), F.lit(None)).when(F.contains(version, F.lit("/")), F.concat(F.split_part(version, F.lit("/"), F.lit(1)), F.lit(":"), tag)).otherwise(F.concat(F.lit("custom:"), tag))
    return F.coalesce(named, F.lit("custom:unknown"))


def local_name(qname: Column) -> Column:
    """Behind the last colon."""
    return F.substring_index(qname, ":", -1)


def prefix(qname: Column) -> Column:
    """Before the first colon; empty without."""
    return F.when(F.contains(qname, F.lit(":")), F.substring_index(qname, ":", 1)).otherwise(F.lit(""))


def unit_label(numerator: Column, denominator: Column | None = None) -> Column:
    """A unit's local name, or `A_per_B`."""
    over = local_name(denominator) if denominator is not None else F.lit(None).cast("string")
    return F.when(over.isNull(), local_name(numerator)).otherwise(F.concat_ws("_per_", local_name(numerator), over))


def mime_type(name: Column) -> Column:
    """From the file extension."""
    out = F.when(F.lit(False), F.lit(""))
    for ext, kind in MIME_TYPES:
        out = out.when(name.rlike(rf"(?i)\.({ext})$"), kind)
    return out.otherwise("application/octet-stream")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(content: Column) -> Column:
    return F.left(F.sha1(content), F.lit(12))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def approx_tokens(text: Column) -> Column:
    """Four characters a token."""
    return F.floor(F.length(text) / 4).cast("int")


def compact_date(value: Column) -> Column:
    """yyyymmdd from text, an int or a float; null if it isn't eight digits or no date."""
    digits = F.regexp_replace(F.trim(value.cast("string")), r"\.0+$", "")
    return F.when(digits.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd"))))


def iso_date(value: Column) -> Column:
    """The ISO date that a text starts with; null if there is none."""
    return F.left(value, F.lit(10)).try_cast("date")


def advance_quarters(day: Column, quarters: Column | int) -> Column:
    """Later by quarters, the day clamped to the month."""
    n = F.lit(quarters) if isinstance(quarters, int) else quarters
    return F.add_months(day, n * 3)


def period_ends(start: Column, end: Column, months: int) -> Column:
    """All ends of month-, quarter- or year-long calendar periods in a range, as an array."""
    first = F.trunc(start, {1: "month", 3: "quarter", 12: "year"}[months])
    ends = F.transform(F.sequence(first, end, F.expr(f"interval {months} months")), lambda d: F.last_day(F.add_months(d, months - 1)))
    return F.filter(ends, lambda d: d.between(start, end))


def labour_release(period_end: Column) -> Column:
    """42 days later, on the Tuesday then or next."""
    return F.next_day(F.date_add(period_end, 41), "TU")


def close_to(a: Column, b: Column, tolerance: float) -> Column:
    """Equal up to a share of the larger size, or of 1; false for null or NaN."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * tolerance, F.lit(False)) & ~F.coalesce(F.isnan(a) | F.isnan(b), F.lit(True))


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value)) / 30


def signed_exp(value: Column) -> Column:
    """The inverse of `signed_log`."""
    return F.signum(value) * F.expm1(F.abs(value) * 30)


def ratio(a: Column, b: Column) -> Column:
    """a over b as floating-point numbers divide: infinite or NaN over zero (of either sign), where `/` raises."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def relative_delta(now: Column, prior: Column) -> Column:
    """Change over the prior's size, or over 1 if that is larger."""
    return (now - prior) / F.greatest(F.abs(prior), F.lit(1.0))


def scaled_number(text: Column, scale: Column, sign: Column) -> Column:
    """A displayed number with thousands separators, times ten to the scale, negative for sign `-`; null if it is none."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double") * F.pow(F.lit(10.0), F.coalesce(scale, F.lit(0))) * F.when(sign == "-", -1.0).otherwise(1.0)


EDGE = "array<struct<target_name:string,relationship_type:string,evidence_span:string,weight_qualifier:string,confidence:double>>"


def edges_from_response(text: Column) -> Column:
    """The well-formed elements of the JSON array in a response, whatever stands around it; an empty array if there is none.

    Elements need a target, a relation and evidence; relations are lower-cased, and a missing confidence is 0.5."""
    found = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), EDGE)
    tidy = lambda c: F.trim(F.coalesce(c, F.lit("")))
    clean = F.transform(found, lambda e: F.struct(tidy(e["target_name"]).alias("target_name"), F.lower(tidy(e["relationship_type"])).alias("relationship_type"), tidy(e["evidence_span"]).alias("evidence_span"), tidy(e["weight_qualifier"]).alias("weight_qualifier"), F.coalesce(e["confidence"], F.lit(0.5)).alias("confidence")))
    good = F.filter(clean, lambda e: (e["target_name"] != "") & (e["relationship_type"] != "") & (e["evidence_span"] != ""))
    return F.coalesce(good, F.from_json(F.lit("[]"), EDGE))


def fiscal_order(period: Column) -> Column:
    """Q1 to Q4 as 1 to 4, FY as 5, a bare Q as 1, anything else as 0."""
    out = F.when(F.lit(False), F.lit(0))
    for name, place in FISCAL_ORDER.items():
        out = out.when(period == name, place)
    return out.otherwise(0)


def fiscal_period_of_form(form: Column, hint: Column) -> Column:
    """10-K is FY, 10-Q the hint or Q, any other form itself."""
    return F.when(form.startswith("10-K"), "FY").when(form.startswith("10-Q"), F.coalesce(F.nullif(hint, F.lit("")), F.lit("Q"))).otherwise(form)


def labour_series_id(industry: Column, measure: Column) -> Column:
    """Survey and adjustment, six-digit industry, all states, areas and sizes, measure."""
    return F.concat(F.lit("JTS"), F.rpad(industry, 6, "0"), F.lit("000000000"), measure)
