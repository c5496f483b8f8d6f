"""Extractors that need no document tree: patterns, headers, robots.txt, sitemaps, srcset, climbing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# Patterns of addresses in page bodies and in scripts.
BODY_ENDPOINT = (
    r"(?:("
    r"(?:\.{1,2}/[A-Za-z0-9\-_/\\?&@\.?=%]+)"
    r"|(https?://[A-Za-z0-9_\-\.]+([\.]{0,2})?/[A-Za-z0-9\-_/\\?&@\.?=%]+)"
    r"|(/[A-Za-z0-9\-_/\\?&@\.%]+\.(?:aspx?|action|cfm|cgi|do|pl|css|x?html?|js(?:p|on)?|pdf|php5?|py|rss))"
    r"|([A-Za-z0-9\-_?&@\.%]+/[A-Za-z0-9/\\\-_?&@\.%]+\.(?:aspx?|action|cfm|cgi|do|pl|css|x?html?|js(?:p|on)?|pdf|php5?|py|rss))"
    r"))"
)
SCRIPT_ENDPOINT = (
    r"""(?:"|'|\s)\s*("""
    r"""(?:https?://[A-Za-z0-9_\-.]+(?::\d{1,5})?(?:\.{1,2})?/[A-Za-z0-9/\-_.%]+(?:(?:\?|#)[^"'\s]*)?)"""
    r"""|(?:\.{1,2}/)?[a-zA-Z0-9\-_/\\%]+\.(?:aspx?|js(?:on|p)?|html|php5?|action|do)(?:(?:\?|#)[^"'\s]*)?"""
    r"""|(?:\.{0,2}/)[a-zA-Z0-9\-_/\\%]+(?:/|\\)[a-zA-Z0-9\-_]{3,}(?:(?:\?|#)[^"'\s]*)?"""
    r"""|(?:\.{0,2})[a-zA-Z0-9\-_/\\%]{3,}/"""
    r""")\s*(?:"|'|\s)"""
)


def matches(c: str | Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(U.text(c), F.lit(pattern), F.lit(group))


def body_endpoints(body: str | Column) -> Column:
    return F.array_distinct(matches(body, BODY_ENDPOINT, 1))


def script_endpoints(body: str | Column) -> Column:
    return F.array_distinct(matches(body, SCRIPT_ENDPOINT, 1))


def is_script(url: str | Column, headers: str | Column) -> Column:
    """Stand-alone script or style sheet, common libraries left out."""
    p = F.lower(U.path(url))
    kind = F.lower(F.coalesce(header(headers, "content-type"), F.lit("")))
    return (p.endswith(".js") | p.endswith(".css") | kind.contains("/javascript")) & ~U.is_js_library(p)


def header(headers: str | Column, name: str) -> Column:
    """Value of a header, whatever the case of its name; null if absent."""
    low = F.transform(F.map_entries(U.col(headers)), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    return F.try_element_at(F.filter(low, lambda e: e["k"] == name.lower()), F.lit(1))["v"]


def srcset(c: str | Column) -> Column:
    """Addresses of a srcset: the first word of each candidate."""
    return F.filter(F.transform(F.split(U.text(c), ","), lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1)), lambda x: x != "")


def link_header(c: str | Column) -> Column:
    """Addresses in angle brackets of a Link header."""
    pieces = F.flatten(F.transform(F.split(U.text(c), ","), lambda x: F.split(x, ";")))
    inside = F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x.startswith("<") & x.endswith(">"))
    return F.transform(inside, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def refresh_header(c: str | Column) -> Column:
    """Address of a Refresh header; empty for none."""
    second = F.try_element_at(F.split(U.text(c), "url="), F.lit(2))
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.trim(second), r";+$", ""), r"""^["']+|["']+$""", ""), F.lit(""))


def header_links(df: DataFrame, key: str, headers: str = "headers", follow: bool = True) -> DataFrame:
    """(key, tag, attribute, raw) of the addresses in response headers."""
    one = lambda n: F.filter(F.array(F.coalesce(header(headers, n), F.lit(""))), lambda x: x != "")
    found = [("content-location", one("content-location")), ("link", link_header(header(headers, "link"))), ("refresh", F.filter(F.array(refresh_header(header(headers, "refresh"))), lambda x: x != ""))]
    if follow:
        found.append(("location", one("location")))

    def row(n: str):
        return lambda x: F.struct(F.lit("header").alias("tag"), F.lit(n).alias("attribute"), x.alias("raw"))

    rows = F.flatten(F.array(*[F.transform(v, row(n)) for n, v in found]))
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def script_file_links(df: DataFrame, key: str, url: str = "url", body: str = "body", headers: str | None = "headers") -> DataFrame:
    """(key, tag, attribute, raw) of the addresses in stand-alone scripts and style sheets."""
    kind = F.col(headers) if headers else F.create_map().cast("map<string,string>")
    found = df.where(is_script(url, kind)).select(key, F.explode(script_endpoints(body)).alias("raw"))
    return found.select(key, F.lit("js").alias("tag"), F.lit("text").alias("attribute"), "raw")


def robots_links(body: str | Column) -> Column:
    """array<struct<directive,target>> of a robots.txt: allow..., disallow and sitemap lines with ": "."""
    lines = F.filter(F.split(U.text(body), "\n"), lambda x: x.contains(": "))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ": ", 1))).alias("directive"), F.trim(F.regexp_replace(x, r"(?s)^.*?: ", "")).alias("target")))
    return F.filter(pairs, lambda p: p["directive"].startswith("allow") | p["directive"].isin("disallow", "sitemap"))


def sitemap_links(body: str | Column) -> Column:
    pieces = F.filter(F.split(U.text(body), "<loc>"), lambda x: x.contains("</loc>"))
    return F.transform(pieces, lambda x: F.trim(F.substring_index(x, "</loc>", 1)))


def known_files(url: str | Column) -> Column:
    return F.array(F.concat(U.root(url), F.lit("/robots.txt")), F.concat(U.root(url), F.lit("/sitemap.xml")))


def climb(url: str | Column) -> Column:
    """The folders above an address: /a/, /a/b/ ..."""
    s = U.segments(url)
    n = F.size(s) - 1
    steps = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.concat(U.root(url), F.lit("/"), F.array_join(F.slice(s, F.lit(1), i), "/"), F.lit("/")))


def valid_reference(c: str | Column) -> Column:
    t = F.lower(F.trim(U.text(c)))
    return (t != "") & ~U.any_of([t.startswith(x) for x in ("data:", "mailto:", "javascript:", "vbscript:")])


def onclick_targets(c: str | Column) -> Column:
    return F.array_distinct(matches(c, r"""['"]((?:https?://|/)[^'"]+)['"]""", 1))


def words(c: str | Column) -> Column:
    return F.size(F.filter(F.split(U.text(c), r"\s+"), lambda x: x != ""))


def lines(c: str | Column) -> Column:
    """Number of lines; a trailing line end adds none."""
    t = U.text(c)
    n = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(t == "", 0).otherwise(n + F.when(t.endswith("\n"), 0).otherwise(1))
