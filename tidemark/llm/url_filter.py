"""URL filters with redirect equivalence, in DataFrame expressions alone.

Rules name a host (and its subdomains) and a path prefix, and allow or block; the longest fitting rule decides.
URLs that lead to each other by a redirect or a canonical link are aliases: they form the connected components of a
graph whose edges are logged redirects, canonical links and meta refreshes; on demand also those between spellings of a URL
that servers often redirect to one form, which no page states.  A URL without a rule is blocked if an alias of it is
blocked by rule; a URL that a rule allows stays allowed whatever its aliases are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.graph import components

#: The rules of the registered query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, block before allow at equal length; null if none does.

    The rule list is a parameter of the query, so it is part of the plan, tried from the longest rule on."""
    out = None
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block")):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        found = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def spelling(url: Column) -> Column:
    """The spelling that aliases by form share: no scheme, no `www.` or `m.` host, no fragment, no tracking query, no last slash, index page or `.html`."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"(\.html?|/+)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_\w*|ref|gclid|fbclid)(=|$)")))
    kept = F.array_join(pairs, "&")
    return F.when(host == "", url).otherwise(F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def _tags(html: Column, name: str, mark: str) -> Column:
    """The tags `name` of a page that contain `mark`; pages without the mark are not searched."""
    return F.when(F.contains(F.lower(html), F.lit(mark)), F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}\b[^>]*>)"), 1), lambda t: F.contains(F.lower(t), F.lit(mark))))


def _without_dots(path: Column) -> Column:
    """A path from the root with `.` and `..` segments resolved."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"/\.\.?$", "$0/"), "^/", ""), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == ".", a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def absolute(target: Column, base: Column) -> Column:
    """A link's target as a URL, resolved against its page's URL; null where it is empty or of a scheme without `//`."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(path_of(base), r"^/|[^/]*$", ""))
    whole = F.when(target.rlike("(?i)^[a-z][a-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(root, _without_dots(path), rest))
    inside = (host_of(base) != "") & (target != "") & ~target.rlike("(?i)^[a-z][a-z0-9+.-]*:")
    same = F.concat(root, path_of(base))
    return whole.when(inside & target.startswith("?"), F.concat(same, target)).when(inside & target.startswith("#"), F.concat(F.regexp_replace(base, "(?s)#.*$", ""), target)).when(inside, F.concat(root, _without_dots(F.concat(folder, path)), rest))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): URLs that a page's canonical link or meta refresh joins."""
    html, url = F.col("html"), F.col("url")
    href, refresh = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", r"(?is)\bcontent\s*=\s*[\"']?\s*\d+\s*;\s*url\s*=\s*'?([^\"'\s>]+)"
    canonical = F.transform(F.filter(_tags(html, "link", "canonical"), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b")), lambda t: F.regexp_extract(t, href, 1))
    moved = F.transform(F.filter(_tags(html, "meta", "refresh"), lambda t: t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")), lambda t: F.regexp_extract(t, refresh, 1))
    targets = F.concat(F.coalesce(canonical, F.array().cast("array<string>")), F.coalesce(moved, F.array().cast("array<string>")))
    links = pages.filter(url.isNotNull()).select("url", F.explode(targets).alias("to")).select("url", absolute(F.regexp_replace("to", "(?i)&amp;", "&"), url).alias("to")).filter("to is not null")
    return links.select(url.alias("src"), F.col("to").alias("dst"))


def form_edges(urls: DataFrame) -> DataFrame:
    """(src, dst): from each URL with a host to the form that its spellings share, marked so that it equals no URL."""
    return urls.distinct().filter(host_of(F.col("url")) != "").select(F.col("url").alias("src"), F.concat(F.lit("\x01"), spelling(F.col("url"))).alias("dst"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, spellings: bool = False) -> DataFrame:
    """Add `host`, `path`, `rule`, `verdict` and `alias` (what the URL's aliases share) to pages (page_id, url, html).

    `redirects` (src, dst) are further pairs of URLs, as a crawler logs them; with `spellings`, URLs that differ as `spelling`
    says count as redirected to one form.  Null URLs and those without `://` have
    no host and fit no rule, and a null URL has no alias.  URLs that are only linked to are judged like pages when
    decisions spread.  Repeated pages are judged alike; columns of the names added are replaced; empty tables give
    empty results.
    """
    own = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict", "alias"}]
    names = {c.lower() for c in own}
    node, found, hit = (next(n for n in (f"__{w}{'_' * k}" for k in range(len(own) + 1)) if n not in names) for w in ("node", "found", "hit"))
    url = F.col("url")
    judged = pages.select(*(F.col(f"`{c}`") for c in own), host_of(url).alias("host"), path_of(url).alias("path"), url.alias(node)).withColumn(found, fitting_rule(F.col("host"), F.col("path"), rules))
    links = link_edges(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col(redirects.columns[0]).alias("src"), F.col(redirects.columns[1]).alias("dst")).dropna())
    links = stored(links, "links")
    ends = stored(links.select(F.col("src").alias("url")).union(links.select("dst")).distinct(), "ends")
    edges = links.unionByName(form_edges(pages.select("url").union(ends))) if spellings else links
    groups = stored(components(edges), "groups")
    blocked = judged.filter(f"`{found}`.verdict = 'block'").select(node)
    outside = ends.filter(fitting_rule(host_of(url), path_of(url), rules)["verdict"] == "block").select(url.alias(node))
    of = groups.select(F.col("node").alias(node), F.col("component").alias("alias"))
    bad = blocked.union(outside).distinct().join(of, node, "left").select(F.coalesce("alias", node).alias("alias")).distinct().withColumn(hit, F.lit(True))
    # pages that a rule decides need no aliases' verdict, but still their alias
    placed = judged.join(of, node, "left").withColumn("alias", F.coalesce("alias", node))
    spread = placed.join(bad, "alias", "left")
    verdict = F.coalesce(F.col(f"{found}.verdict"), F.when(F.col(hit), F.lit("block")), F.lit("allow"))
    return spread.select(*(F.col(f"`{c}`") for c in own), "host", "path", F.col(f"{found}.rule").alias("rule"), verdict.alias("verdict"), "alias")


def op1(pages: DataFrame) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(pages.select("page_id", "url", "html"), RULES).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    """DuckDB: the same parsing, rules and spread, with a recursive walk over the links."""
    host = lambda u: f"coalesce(translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '')"
    path = lambda u: f"coalesce(regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"

    def found(h: str, p: str, what: int) -> str:
        order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
        return "case " + " ".join(f"when ({h} = '{n}' or {h} like '%.{n}') and starts_with({p}, '{x}') then '{(n + x, v)[what]}'" for n, x, v in order) + " end"

    def without_dots(p: str) -> str:
        parts = f"string_split(regexp_replace(regexp_replace({p}, '(/\\.\\.?)$', '\\1/'), '^/', ''), '/')"
        step = "lambda a, x: case when x = '.' then a when x = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end"
        return f"case when regexp_matches({p}, '/\\.\\.?(/|$)') then list_reduce({parts}, {step}, '') else {p} end"

    tag = lambda name, mark: f"list_filter(regexp_extract_all(html, '(<{name}\\b[^>]*>)', 1, 'is'), lambda t: regexp_matches(t, '{mark}', 'i'))"
    quote = "[\"'']?"
    canonical = f"list_transform({tag('link', f'\\brel\\s*=\\s*{quote}canonical\\b')}, lambda t: regexp_extract(t, '\\bhref\\s*=\\s*{quote}([^\"''\\s>]+)', 1, 'is'))"
    moved = f"list_transform({tag('meta', f'\\bhttp-equiv\\s*=\\s*{quote}refresh\\b')}, lambda t: regexp_extract(t, '\\bcontent\\s*=\\s*{quote}\\s*\\d+\\s*;\\s*url\\s*=\\s*''?([^\"''\\s>]+)', 1, 'is'))"
    scheme = "regexp_extract(url, '^(.*?)://', 1, 's')"
    return f"""with recursive page as (select page_id, url, html, {host('url')} h, {path('url')} p, url n from pages),
        judged as (select *, {found('h', 'p', 0)} rule, {found('h', 'p', 1)} verdict from page),
        target as (select url, n, unnest(list_concat(coalesce({canonical}, []), coalesce({moved}, []))) t from page where url is not null),
        plain as (select url, n, regexp_replace(t, '&amp;', '&', 'gi') t, {scheme} || '://' || {host('url')} root, {path('url')} own from target),
        cut as (select *, regexp_extract(t, '^([^?#]*)', 1, 's') path, regexp_extract(t, '^[^?#]*(.*)$', 1, 's') rest,
            '/' || regexp_replace(own, '^/|[^/]*$', '', 'g') folder, {host('url')} <> '' and t <> '' and not regexp_matches(t, '^[a-z][a-z0-9+.-]*:', 'i') inside from plain),
        whole as (select n, case when regexp_matches(t, '^[a-z][a-z0-9+.-]*://', 'i') then t when starts_with(t, '//') then {scheme} || ':' || t
            when starts_with(t, '/') then root || {without_dots('path')} || rest when inside and starts_with(t, '?') then root || own || t
            when inside and starts_with(t, '#') then regexp_replace(url, '#.*$', '', 's') || t when inside then root || {without_dots('(folder || path)')} || rest end t from cut),
        edge as (select n a, t b, {found(host('t'), path('t'), 1)} v from whole where t is not null),
        both_ways as (select a, b from edge union select b, a from edge),
        bad as (select n from judged where verdict = 'block' union select b from edge where v = 'block'),
        reach as (select n from bad union select b from reach join both_ways on n = a)
        select page_id, h as host, p as path, rule, coalesce(verdict, case when n in (select n from reach where n is not null) then 'block' end, 'allow') as verdict from judged"""
