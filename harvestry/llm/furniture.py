"""Problem 4: page boilerplate mixed with main content.

Method: two-pass block rules (see blocks): length, stop-word density, link density
and the weights of terms decide blocks; ambiguous short blocks inherit the label
of their nearest decided neighbours.  The weights are learned from all of the
table's own pages (blocks.learned); no furniture phrases are listed.
Then one narrow pass over the pages; what it shuffles to make repeated rows one is the
list of line numbers, not the text.

Defined cases: null or empty markdown_ir has no furniture and an empty body;
repeated rows give one row each; rows without page_id are left out; lines of any
length are read whole; of two rows with one page_id and different texts both
count; a table without pages to learn from is judged by general weights.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Rules, learned, streamed
from .text import map_arrow


def furniture_lines(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(page_id, line_no): the lines that are not the page's own content, 1-based."""
    rules = learned(pages) if rules is None else rules

    def rows(batches):
        for batch in batches:
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if i is not None and t:
                    bad = [n for n, b in enumerate(rules.furniture(t.split("\n")), 1) if b]
                    if bad:
                        yield i, bad

    found = streamed(pages.select("page_id", "markdown_ir"), rows, "page_id long, lines array<int>", 5000).distinct()
    return found.select("page_id", F.explode("lines").alias("line_no")).distinct()


def split_body(rules: Rules, text: str | None) -> tuple[str, int, int]:
    """Main body, number of furniture lines, number of own lines."""
    lines = (text or "").split("\n")
    bad = rules.furniture(lines) if text else [False] * len(lines)
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(x for x, b in zip(lines, bad) if not b)).strip("\n")
    return body, sum(bad), sum(1 for x, b in zip(lines, bad) if not b and x.strip())


def main_bodies(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(page_id, main_body, furniture_lines, own_lines) of every page."""
    rules = learned(pages) if rules is None else rules

    def rows(ids, texts):
        return ((i, *split_body(rules, t)) for i, t in zip(ids, texts) if i is not None)

    out = map_arrow(pages.select("page_id", "markdown_ir"), rows, "page_id long, main_body string, furniture_lines int, own_lines int")
    # one row for a repeated row: the text goes through the shuffle only here, where it is the result
    return out.groupBy("page_id").agg(F.min(F.struct("main_body", "furniture_lines", "own_lines")).alias("r")).select("page_id", "r.*")


_drop = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head)\b.*?(?:</\1\s*>|\Z)|<!doctype[^>]*>")
_block = re.compile(r"(?i)</?(?:p|div|section|article|main|aside|nav|header|footer|ul|ol|table|tr|blockquote|form|figure|br|hr|body|html|pre|h[1-6]|li|td|th)\b[^>]*>")
_open = re.compile(r"(?i)<(h[1-6]|li|a)\b([^>]*)>")
_href = re.compile(r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_tag = re.compile(r"(?s)<[a-zA-Z/!][^>]*>?")


def blocks_of_html(body: str) -> list[str]:
    """Blocks of an HTML text as Markdown lines, for the same block rules."""
    text = _drop.sub(" ", body)

    def mark(m: re.Match) -> str:
        kind = m.group(1).lower()
        if kind[0] == "h" and kind[1:].isdigit():
            return f"\n{'#' * int(kind[1:])} "
        if kind == "li":
            return "\n* "
        href = _href.search(m.group(2))
        return "\x01" + (next((g for g in href.groups() if g is not None), "") if href else "") + "\x02"

    text = _open.sub(mark, text)
    text = re.sub(r"(?i)</a\s*>", "\x03", text)
    text = _tag.sub("", _block.sub("\n", text))
    text = re.sub("\x01([^\x02]*)\x02([^\x03\x01]*)\x03", lambda m: f"[{m.group(2).strip()}]({m.group(1)})" if m.group(2).strip() else "", text)
    text = unescape(re.sub("[\x01\x02\x03]", " ", text))
    out = []
    for x in text.split("\n"):
        x = re.sub(r"[ \t\r\f\v]+", " ", x).strip()
        if x.startswith("[") and x.count("](") > 1 and not re.sub(r"\[[^\]]*\]\([^)]*\)", "", x).strip():
            out += re.findall(r"\[[^\]]*\]\([^)]*\)", x)
        elif x and x not in ("*", "#"):
            out.append(x)
    return out


def response_bodies(responses: DataFrame) -> DataFrame:
    """(response_id, main_body) of every answer's HTML by the same rules; null and empty bodies give an empty main body.

    The rules are learned from the blocks of all answers.
    """
    rules = learned(responses, "response_id", "url", "body", lambda body: "\n".join(blocks_of_html(body)))

    def rows(ids, bodies):
        for i, b in zip(ids, bodies):
            if i is not None:
                lines = blocks_of_html(b) if b else []
                yield i, "\n".join(x for x, f in zip(lines, rules.furniture(lines)) if not f)

    out = map_arrow(responses.select("response_id", "body"), rows, "response_id long, main_body string")
    return out.groupBy("response_id").agg(F.min("main_body").alias("main_body"))
