"""Text of filed documents: markup to text, items, chunks, excerpts."""

from __future__ import annotations

import ctypes
import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn

#: Tags at which a line ends, and tags whose content is no text.
BLOCK_TAGS = [
    "p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol",
    "table", "header", "footer", "nav", "title", "blockquote",
]
HIDDEN_TAGS = ["script", "style", "noscript", "ix:header", "ix:hidden", "ix:resources", "ix:references", "ix:relationship"]
#: Own additions: parts of tables, rules, definitions and preformatted text, which browsers put on lines of their own too.
MORE_BLOCK_TAGS = ["thead", "tbody", "tfoot", "hr", "pre", "dl", "dt", "dd"]
LINE_TAGS = frozenset(BLOCK_TAGS + MORE_BLOCK_TAGS)
CHUNK_CHARS, OVERLAP_CHARS, LOOK_BACK = 4000, 800, 200
#: Bytes of markup whose text a worker holds as Python strings at once.
SLICE_BYTES = 1 << 20
#: Characters that chunks do not begin or end with: all that count as white space.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

#: Headings of a filing's items.
ITEM = r"(?im)^[^\S\n]*item\s+(\d{1,2}[A-Z]?)\.?\s+([^\n]{0,160})"
ITEM_8K = r"(?im)^[^\S\n]*item\s+(\d+\.\d{2})\.?\s+([^\n]{0,160})"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif tag in LINE_TAGS:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in LINE_TAGS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag in LINE_TAGS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def plain_text(html: str | None) -> str:
    """Visible text: lines at block tags, compatibility forms folded, single spaces, at most one empty line."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    text = unicodedata.normalize("NFKC", "".join(parser.parts))
    text = re.sub(r"[^\S\n]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text)).strip()


def slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Cut texts so that each slice holds about `limit` bytes at most, and one text at least."""
    if len(texts) > 1 and texts.nbytes > limit:
        half = len(texts) // 2
        yield from slices(texts.slice(0, half), limit)
        yield from slices(texts.slice(half), limit)
    else:
        yield texts


def html_to_text(html: Column) -> Column:
    """`plain_text` of a column.

    Arrow batches are taken in slices of at most SLICE_BYTES and pages one by one, so that a worker holds Python strings of
    one slice's results, however many pages a batch or a task has.  Memory that is free again goes back after each batch."""

    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                yield pa.array((plain_text(page.as_py()) for page in part), pa.string(), size=len(part))
            del batch, part
            pa.default_memory_pool().release_unused()
            if trim:
                trim(0)

    return F.arrow_udf(convert, "string")(html)


def chunk_text(text: Column) -> Column:
    """Overlapping pieces of at most CHUNK_CHARS, cut at the last space of their final LOOK_BACK characters if there is one.

    A fold walks from chunk to chunk, since where one ends decides where the next begins.  It reads the text through pieces of
    CHUNK_CHARS characters, so the work grows with the length.  Texts of one chunk stay as they are; chunks of longer ones lose
    white space at both ends, and what is empty then goes.  A null or empty text has no chunks."""

    def part(whole: Column, at: Column, length: Column | int) -> Column:
        """At most CHUNK_CHARS characters of the text from a place on: they lie in two neighbouring pieces."""
        i = F.floor(at / CHUNK_CHARS).cast("int")
        two = F.concat(F.get(whole["pieces"], i), F.coalesce(F.get(whole["pieces"], i + 1), F.lit("")))
        return F.substring(two, at - i * CHUNK_CHARS + 1, F.lit(length) if isinstance(length, int) else length)

    def span(whole: Column, at: Column) -> Column:
        tail = part(whole, at + (CHUNK_CHARS - LOOK_BACK), LOOK_BACK)
        end = F.when(at + CHUNK_CHARS >= whole["n"], whole["n"]).otherwise(at + CHUNK_CHARS - F.instr(F.reverse(tail), F.lit(" ")))
        return F.struct(at.cast("int").alias("start"), end.cast("int").alias("stop"))

    def following(whole: Column, spans: Column) -> Column:
        last = F.element_at(spans, -1)
        return F.when(last["stop"] >= whole["n"], spans).otherwise(F.concat(spans, F.array(span(whole, last["stop"] - OVERLAP_CHARS))))

    def cut(whole: Column) -> Column:
        steps = F.sequence(F.lit(1), F.ceil(whole["n"] / (CHUNK_CHARS - LOOK_BACK - OVERLAP_CHARS)).cast("int"))
        spans = F.aggregate(steps, F.array(span(whole, F.lit(0))), lambda acc, _: following(whole, acc))
        parts = F.transform(spans, lambda s: F.btrim(part(whole, s["start"], s["stop"] - s["start"]), F.lit(WHITE_SPACE)))
        return F.filter(parts, lambda c: c != "")

    n = F.length(text)  # counts characters, so it is taken once a text, beside the pieces, and not at every step
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK_CHARS}}}"), F.lit(0))
    long = F.get(F.transform(F.array(F.struct(pieces.alias("pieces"), n.alias("n"))), cut), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(n > CHUNK_CHARS, long).when(n > 0, F.array(text)).otherwise(none)


def items(docs: DataFrame, key: str, pattern: str = ITEM) -> DataFrame:
    """(key, text) to one row for each item: the text from a heading to the next; of repeated headings the longest body, the first of equals.

    A null text has no items.  Headings are marked by a character that texts are freed of before and get back behind."""
    mark, escape = "\x00", "\x01"
    bare = F.when(F.col("text").rlike(f"[{mark}{escape}]"), F.replace(F.replace("text", F.lit(escape), F.lit(escape + "\x02")), F.lit(mark), F.lit(escape + "\x03"))).otherwise(F.col("text"))
    back = lambda c: F.when(F.contains(c, F.lit(escape)), F.replace(F.replace(c, F.lit(escape + "\x03"), F.lit(mark)), F.lit(escape + "\x02"), F.lit(escape))).otherwise(c)
    marked = F.regexp_replace(bare, pattern, mark + "$1" + mark + "$2" + mark)
    parts = F.slice(F.split(marked, mark), 2, F.greatest(F.size(F.split(marked, mark)) - 1, F.lit(0)))
    rows = docs.filter("text is not null").select(key, parts.alias("p")).select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 3).cast("int")), lambda i: F.struct(F.get("p", i * 3).alias("item_id"), F.get("p", i * 3 + 1).alias("title"), F.get("p", i * 3 + 2).alias("body")))).alias("pos", "x"))
    found = rows.select(key, "pos", F.upper("x.item_id").alias("item_id"), F.trim(back(F.col("x.title"))).alias("item_title"), F.regexp_replace(back(F.col("x.body")), r"^\s+|\s+$", "").alias("text")).filter("item_id is not null and text <> ''")
    best = found.groupBy(key, "item_id").agg(F.max_by(F.struct("item_title", "text"), F.struct(F.length("text"), -F.col("pos"))).alias("b"))
    return best.select(key, "item_id", "b.item_title", "b.text")


def chunk_rows(docs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, text) to one row for each chunk: index, number of chunks, characters, approximate tokens."""
    pieces = docs.filter(F.col("text") != "").select(*by, chunk_text(F.col("text")).alias("c"))
    # the outer form, since the plain one lets the planner filter by the chunks before it makes them, and so make them thrice
    rows = pieces.select(*by, F.size("c").alias("n_chunks_in_item"), F.posexplode_outer("c").alias("chunk_idx", "text")).filter("text is not null")
    return rows.withColumns({"n_chars": F.length("text"), "n_tokens_approx": fn.approx_tokens(F.col("text"))})


def first_chunks(rows: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """The first chunks of each item."""
    w = Window.partitionBy(*by).orderBy("chunk_idx")
    return rows.withColumn("__place", F.row_number().over(w)).filter(F.col("__place") <= n).drop("__place")


def earnings_excerpts(filings_text: DataFrame) -> DataFrame:
    """Results announcements: chunks of item 2.02 of 8-K filings, as rows of their own table."""
    return excerpts(filings_text.filter(F.col("form").startswith("8-K") & (F.col("item_id") == "2.02")))


def excerpts(rows: DataFrame) -> DataFrame:
    """Text chunks as rows of the excerpts' table."""
    return rows.select("entity_id", "accession", "form", "item_id", "chunk_idx", "text", "n_chars", "n_tokens_approx", F.lit("press_release").alias("coverage_class"), F.lit("derived:filings_text/8-K_item_2.02").alias("perspective"))


#: What the XML parser reads otherwise than the HTML parser: raw content, declarations, other entities, odd line ends.
_NOT_XML = re.compile(r"<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|plaintext)|<[!?]|&(?!(?:amp|lt|gt|quot);)|\r|=\s*[\"'][^\"'<>]*[\n\t]", re.I)
_FACT_TAGS = frozenset(["context", "unit", "explicitmember", "startdate", "enddate", "instant", "measure", "nonfraction"])


class _FactState:
    """Contexts, units and numeric facts of one inline-tagged document, from its tags and texts in order."""

    def __init__(self) -> None:
        super().__init__()
        self.contexts: dict[str, dict] = {}
        self.units: dict[str, list[str]] = {}
        self.facts: list[dict] = []
        self.open: list[list] = []  # facts whose text is being read
        self.context: dict | None = None
        self.unit: list[str] | None = None
        self.field: str | None = None
        self.axis = ""

    def handle_starttag(self, tag, attrs):
        a, local = dict(attrs), tag.rsplit(":", 1)[-1]
        if local == "context":
            self.context = self.contexts.setdefault(a.get("id", ""), {"dims": {}})
        elif local == "unit":
            self.unit = self.units.setdefault(a.get("id", ""), [])
        elif local == "explicitmember":
            self.axis, self.field = a.get("dimension", "").rsplit(":", 1)[-1], "member"
        elif local in ("startdate", "enddate", "instant", "measure"):
            self.field = local
        elif local == "nonfraction" and a.get("xsi:nil", "false") != "true":
            self.open.append([a, ""])

    def handle_data(self, data):
        for fact in self.open:
            fact[1] += data
        text = data.strip()
        if not text or not self.field:
            return
        if self.field == "measure" and self.unit is not None:
            self.unit.append(text.rsplit(":", 1)[-1])
        elif self.field == "member" and self.context is not None:
            self.context["dims"][self.axis] = text.rsplit(":", 1)[-1]
        elif self.context is not None:
            self.context[self.field] = text[:10]

    def handle_endtag(self, tag):
        local = tag.rsplit(":", 1)[-1]
        if local == "context":
            self.context = None
        elif local == "unit":
            self.unit = None
        elif local in ("startdate", "enddate", "instant", "measure", "explicitmember"):
            self.field = None
        elif local == "nonfraction" and self.open:
            a, text = self.open.pop()
            self.facts.append({"concept": a.get("name", ""), "context": a.get("contextref", ""), "unit": a.get("unitref", ""), "scale": a.get("scale", "0"), "sign": a.get("sign", ""), "text": text.strip()})


class _Facts(_FactState, HTMLParser):
    """The same, read by the HTML parser."""


def _read_facts(source: str) -> _FactState:
    """A document's facts: well-formed ones by the XML parser, which is faster and finds the same, others by the HTML parser."""
    if not _NOT_XML.search(source):
        state, parser = _FactState(), expat.ParserCreate()

        def start(tag, attributes):
            tag = tag.lower()
            if tag.rpartition(":")[2] in _FACT_TAGS:
                state.handle_starttag(tag, [(k.lower(), v) for k, v in attributes.items()])

        def end(tag):
            tag = tag.lower()
            if tag.rpartition(":")[2] in _FACT_TAGS:
                state.handle_endtag(tag)

        parser.buffer_text = True  # texts are whole between tags, as the HTML parser gives them
        parser.buffer_size = max(parser.buffer_size, len(source.encode("utf-8", "replace")) + 1)
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, state.handle_data
        try:
            parser.Parse(source, True)
            return state
        except (expat.ExpatError, ValueError):
            pass
    p = _Facts()
    p.feed(source)
    return p


def inline_facts(docs: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, html) to one row for each numeric fact with its period, dimensions (JSON), unit and value.

    Documents are parsed in map tasks; numbers, signs and scales are then worked out by expressions."""
    schema = f"{key} {dict(docs.dtypes)[key]}, concept string, context_id string, period_start string, period_end string, dims map<string,string>, unit string, scale string, sign string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, source in zip(batch[key], batch[html], strict=True):
                p = _read_facts(source or "")
                for f in p.facts:
                    c = p.contexts.get(f["context"], {"dims": {}})
                    rows.append((k, f["concept"], f["context"], c.get("startdate"), c.get("enddate") or c.get("instant"), c["dims"], "_per_".join(p.units.get(f["unit"], [])), f["scale"], f["sign"], f["text"]))
            yield pd.DataFrame(rows, columns=[key, "concept", "context_id", "period_start", "period_end", "dims", "unit", "scale", "sign", "text"])

    raw = docs.select(key, html).mapInPandas(run, schema)
    sorted_dims = F.map_from_entries(F.array_sort(F.map_entries("dims")))
    value = fn.scaled_number(F.col("text"), F.col("scale").try_cast("int"), F.col("sign"))
    return raw.select(key, "concept", "context_id", fn.iso_date(F.col("period_start")).alias("period_start"), fn.iso_date(F.col("period_end")).alias("period_end"), F.when(F.size("dims") == 0, F.lit("")).otherwise(F.to_json(sorted_dims)).alias("dimensions_json"), "unit", value.alias("value")).filter("value is not null and period_end is not null")


def generate(docs: DataFrame, key: str, column: str, make: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """(key, *schema): the rows that a user's function makes of each text, in map tasks; null texts make none."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for k, t in zip(batch[key], batch[column], strict=True) if t is not None for row in make(t)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return docs.select(key, column).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, {schema}")
