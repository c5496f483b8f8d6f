"""Problem 5: source markup of other formats left in text.

Method: nearest-URL page differencing.  Within each host, pages are put in order
of their URL path; each is paired with the neighbour that shares the longer path,
their lines are aligned by longest common subsequence, and shared lines are
deleted as the site's.  What is left is searched for markup (`markup_kinds`) and
turned into clean text that keeps headings, lists, code and formulas
(`clean_pages`).

A neighbour that is the same page fetched again shares all lines, so a pair with
hardly a line of its own says nothing: the next nearest of AROUND pages on each
side takes its place, and where all of them are the same page, nothing is deleted.
Code and what goes over several lines is found in the whole text, before lines are
deleted.  Clean text must keep the headings, fences and paragraphs that pages of a
site share as well: from it a shared line is deleted only if the block rules call
it furniture, or if it is a short label with nothing of the page's own before it,
or after it, and if no code, formula or markup touches it.

Scale: one shuffle by ranges of (host, path, page_id) brings neighbours together,
whatever a host's or an address's size, and cuts hot ones like any others; pages
without an address have no neighbours and are spread by their page_id.  A task
streams its pages and keeps five at a time.  The rows at the edges of a range go to
the ranges beside it too, so that a page has the same neighbours wherever ranges
are cut.

Defined cases: null urls have no neighbour and keep all lines; null or empty
texts have no markup and an empty clean text; repeated rows count once; rows
without page_id are left out; unclosed tags, comments and environments count.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from html import unescape
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Rules, learned
from .text import CODE, map_arrow, site_of

# Element names of HTML.
TAGS = "a|abbr|address|article|aside|audio|b|blockquote|body|br|button|canvas|caption|center|cite|code|col|colgroup|dd|del|details|dfn|div|dl|dt|em|embed|fieldset|figcaption|figure|font|footer|form|frame|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|legend|li|link|main|map|mark|meta|nav|noscript|object|ol|optgroup|option|p|param|picture|pre|q|s|samp|script|section|select|small|source|span|strike|strong|style|sub|summary|sup|svg|table|tbody|td|template|textarea|tfoot|th|thead|time|title|tr|tt|u|ul|var|video|wbr"
_attr = r"(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))?)*"
# Character entity names in common use.
ENTITIES = "amp|lt|gt|quot|apos|nbsp|copy|reg|trade|hellip|mdash|ndash|lsquo|rsquo|ldquo|rdquo|laquo|raquo|bull|middot|times|deg|euro|pound|yen|cent|sect|para|shy|ensp|emsp|thinsp|zwnj|zwj|iexcl|iquest|[aeiouAEIOU](?:acute|grave|circ|uml|tilde|ring)|[nN]tilde|[cC]cedil|szlig|aelig|AElig|oslash|Oslash|larr|rarr|uarr|darr|le|ge|ne|infin|alpha|beta|gamma|delta|lambda|mu|pi|sigma|omega"
HTML = re.compile(rf"<!--|<!doctype\b|</(?:{TAGS})\s*>|<(?:{TAGS}){_attr}\s*/?>|&(?:#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|(?:{ENTITIES}));", re.I)
WIKI = re.compile(
    r"\[\[[^\[\]\n]+\]\]|\[\[(?:File|Image|Datei|Fichier|Archivo|ファイル):|\[https?://[^\s\]]+ [^\]\n]+\](?!\()"
    r"|(?<![\w'])'''?(?=[^\s'])[^\n]*?[^\s']'''?(?!')|^[ \t]*={2,6}[ \t]*[^=\s\d][^=\n]*?[ \t]*={2,6}[ \t]*$|^[ \t]*(?:\{\|.*|\|\}|\|-+|\| .*\|\|.*)[ \t]*$",
    re.M,
)
LATEX = re.compile(
    r"\\(?:begin|end)\{\w+\*?\}|(?<![A-Za-z]:)(?<![\w\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s${])[^$\n]*[\\^_{}=][^$\n]*(?<=\S)\$(?![\w$])|\\\([^\n]+?\\\)|\\\[.+?\\\]|^[ \t]*\\item\b",
    re.M | re.S,
)
KINDS = (("html", HTML), ("wiki", WIKI), ("latex", LATEX))
# What goes over several lines and must stay whole.
LONG = re.compile(r"<!--.*?(?:-->|\Z)|^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)|\\begin\{(\w+\*?)\}.*?(?:\\end\{\1\}|\Z)|\$\$[^$]+(?:\$\$|\Z)|\\\[.+?\\\]", re.M | re.S)
_hint = re.compile(r"[<&\\$=|']|\[\[|\[http")


def _uncoded(text: str) -> str:
    """text with code blanked, on the same lines."""
    return CODE.sub(lambda m: " " + "\n" * m.group().count("\n"), text) if "`" in text else text


def _kinds(uncoded: str) -> list[str]:
    return [k for k, p in KINDS if p.search(uncoded)] if _hint.search(uncoded) else []


def kinds(text: str | None) -> list[str]:
    """Kinds of source markup in the text outside code."""
    return _kinds(_uncoded(text)) if text else []


# What each pattern cannot do without.
_signs = (
    (LONG, ("<!--", "{|", "\\begin", "$$", "\\[")),
    (HTML, ("<", "&")),
    (WIKI, ("[[", "[http", "''", "==", "|")),
    (LATEX, ("\\", "$")),
)


def _touched(text: str, uncoded: str) -> set[int]:
    """Indexes of the lines that code, or markup outside it, is on."""
    out: set[int] = set()
    found = [(text, CODE)] if "`" in text else []
    found += [(uncoded, p) for p, signs in _signs if any(x in uncoded for x in signs)]
    for t, p in found:
        line = at = 0
        for m in p.finditer(t):
            line += t.count("\n", at, m.start())
            last = line + t.count("\n", m.start(), m.end())
            out.update(range(line, last + 1))
            line, at = last, m.end()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Indexes in a of a longest common subsequence of lines with b; blank lines are left out."""
    both = {x for x in a if x} & {x for x in b if x}
    ia = [i for i, x in enumerate(a) if x in both]
    ib = [x for x in b if x in both]
    n, m = len(ia), len(ib)
    lo, hi = 0, 0
    while lo < min(n, m) and a[ia[lo]] == ib[lo]:
        lo += 1
    while hi < min(n, m) - lo and a[ia[n - 1 - hi]] == ib[m - 1 - hi]:
        hi += 1
    out = set(ia[:lo]) | set(ia[n - hi :] if hi else [])
    ia, ib = ia[lo : n - hi], ib[lo : m - hi]
    if ia and ib:
        out |= _aligned([a[i] for i in ia], ib, ia)
    return out


def _aligned(x: list[str], y: list[str], ids: list[int]) -> set[int]:
    """ids of the elements of x in a longest common subsequence with y, exact at every size.

    A row of the table (one for each element of y, from its end) is one integer: bit p is 0 where the length grows with the
    p-th element of x from its end.  Every step-th row is kept and those between are made again on the way back, so that
    memory grows with len(x) * sqrt(len(y)) bits.
    """
    n, m = len(x), len(y)
    ones = (1 << n) - 1
    at: dict[str, int] = {}
    for p, v in enumerate(reversed(x)):
        at[v] = at.get(v, 0) | 1 << p

    def row(v: int, j: int) -> int:
        u = v & at.get(y[j], 0)
        return ((v + u) | (v - u)) & ones

    step = isqrt(m) + 1
    kept = [ones]  # kept[k]: after k * step elements from the end of y
    v = ones
    for k in range(1, m + 1):
        v = row(v, m - k)
        if k % step == 0:
            kept.append(v)
    out: set[int] = set()
    i, j = 0, 0
    block, rows = -1, [ones]
    while i < n and j < m:
        k = m - j
        if k // step != block:
            block = k // step
            rows = [kept[block]]
            for q in range(block * step + 1, min(m, (block + 1) * step - 1) + 1):
                rows.append(row(rows[-1], m - q))
        if x[i] == y[j]:
            out.add(ids[i])
            i, j = i + 1, j + 1
        elif rows[k - block * step] >> (n - 1 - i) & 1:  # the length is the same without x[i]
            i += 1
        else:
            j += 1
    return out


# Headings, list items, quotes, tables, images, fences, formulas and sentences: own content if the block rules do not object.
_own = re.compile(r"^(?:#{1,6} |[*+•-] |\d{1,3}[.)] |>|!\[|```|~~~|\$|\\|[|])|[|]|[.!?…。！？:;：][\"'”’»›」』)\]*_]*$")


def shared_lines(lines: list[str], others: list[str]) -> set[int]:
    """Indexes of the lines shared with the nearest of the other pages that is not the same page again."""
    keys = [" ".join(x.split()) for x in lines]
    full = sum(1 for x in keys if x)
    for other in others:
        shared = common(keys, [" ".join(x.split()) for x in other.split("\n")]) if other else set()
        if full - len(shared) >= max(2, 0.2 * full):
            return shared
    return set()


def own_lines(rules: Rules, text: str, others: list[str]) -> list[int]:
    """Indexes of the page's lines without the furniture it shares with its neighbour."""
    a = text.split("\n")
    every = list(range(len(a)))
    shared = shared_lines(a, others)
    if not shared:
        return every
    bad = rules.furniture(a)
    gone = {i for i in shared if bad[i]}
    for side in (every, every[::-1]):  # short labels at the edges of both pages, whatever the rules know of them
        for i in side:
            x = " ".join(a[i].split())
            if x and i not in gone:
                if i not in shared or len(x) > 60 or _own.search(x):
                    break
                gone.add(i)
    if gone:
        gone -= _touched(text, _uncoded(text))
    return [i for i in every if i not in gone]


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


#: Pages on each side that are looked at as neighbours.
AROUND = 2


def _bounds(keys: DataFrame, parts: int, per: int = 60) -> list[tuple[str, str, int]]:
    """At most parts - 1 keys that cut (site, path, page_id) into ranges of like size, from a sample of about `per` a range.

    The bounds only spread the work; no result depends on them.
    """
    n = max(1, keys.count())
    share = min(1.0, per * parts / n)
    some = sorted((r.site, r.path, r.page_id) for r in (keys if share == 1.0 else keys.sample(False, share, 7)).where("site is not null").collect())
    step = len(some) / parts
    return sorted({some[int(i * step)] for i in range(1, parts)}) if some else []


def _placed(bounds: list[tuple[str, str, int]]):
    """Rows (site, path, page_id, text) with their range and a mark; the last AROUND rows a mapper has of a range go to the next
    range too, the first to the one before, marked as neighbours only.  Among them are the true neighbours of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "ghost", "site", "path", "page_id", "markdown_ir"]
        kinds = [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string()]
        low: dict[int, list[tuple]] = {}
        high: dict[int, list[tuple]] = {}
        for b in batches:
            sites, paths, ids = (b.column(i).to_pylist() for i in range(3))
            parts = [bisect_right(bounds, (s, p, i)) if s is not None else i % (len(bounds) + 1) for s, p, i in zip(sites, paths, ids)]
            by: dict[int, list[tuple]] = {}
            for at, (part, s, p, i) in enumerate(zip(parts, sites, paths, ids)):
                if s is not None:
                    by.setdefault(part, []).append((s, p, i, at))
            for part, keys in by.items():
                keys.sort()
                # of a key that is repeated one row will do: neighbours are other pages
                first = [k for n, k in enumerate(keys) if not n or k[:3] != keys[n - 1][:3]]
                for held, some in ((low, first[:AROUND]), (high, first[-AROUND:])):
                    new = {k[:3]: None for k in some} | {k[:3]: k for k in held.get(part, ())}
                    best = sorted(new)[:AROUND] if held is low else sorted(new)[-AROUND:]
                    at = {k[:3]: k[3] for k in some}
                    held[part] = [new[k] or (*k, b.column(3)[at[k]].as_py()) for k in best]
            cols = [pa.array(parts, kinds[0]), pa.array([False] * len(parts), kinds[1])]
            yield pa.RecordBatch.from_arrays(cols + [b.column(i).cast(kinds[i + 2]) for i in range(4)], names=names)
        ghosts = [(p + 1, True, *row) for p, rows in high.items() if p < len(bounds) for row in rows] + [(p - 1, True, *row) for p, rows in low.items() if p for row in rows]
        for i in range(0, len(ghosts), 200):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ghosts[i : i + 200]), kinds)], names=names)

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[str]]]:
    """(page_id, text, texts of the pages around it, nearest first) of rows in order of (range, site, path, page_id)."""
    held: deque[list] = deque()  # rows around the one to emit next, which is at `at`
    at = 0

    def emit(at: int) -> tuple[int, str, list[str]]:
        now = held[at]
        near = []
        for k in range(max(0, at - AROUND), min(len(held), at + AROUND + 1)):
            x = held[k]
            if now[2] is not None and x[0] == now[0] and x[2] == now[2] and x[4] != now[4]:
                near.append((-_prefix(x[3], now[3]), abs(k - at), k > at, x[5] or ""))
        return now[4], now[5], [x[3] for x in sorted(near, key=lambda x: x[:3])]

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and all(row[k] == held[-1][k] for k in (0, 2, 3, 4, 5)):
                if held[-1][1] and not row[1]:
                    held[-1] = row
                continue  # the row repeated
            held.append(row)
            # the last row may still turn out to be repeated, so AROUND rows after one are waited for
            if len(held) > at + AROUND + 1:
                if not held[at][1]:
                    yield emit(at)
                at += 1
                if at > AROUND:
                    held.popleft()
                    at -= 1
    while at < len(held):
        if not held[at][1]:
            yield emit(at)
        at += 1


def _differenced(pages: DataFrame, fn, schema: str) -> DataFrame:
    """Rows fn(page_id, text, texts of its neighbours)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    path = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    src = pages.select(site_of("url").alias("site"), F.coalesce(path, F.lit("")).alias("path"), F.col("page_id").cast("long").alias("page_id"), "markdown_ir").where("page_id is not null")

    def run(batches):
        held = []
        for i, t, others in _neighbours(batches):
            held.append(fn(i, t, others))
            if len(held) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)

    # More ranges than tasks, so that their hashes spread evenly.
    parts = 4 * max(4, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = src.mapInArrow(_placed(_bounds(src.select("site", "path", "page_id"), parts)), "part int, ghost boolean, site string, path string, page_id long, markdown_ir string")
    return placed.repartition("part").sortWithinPartitions("part", "site", "path", "page_id", "markdown_ir").mapInArrow(run, schema)


def left_kinds(text: str | None, others: list[str]) -> list[str]:
    """Kinds of markup in the lines that differencing leaves of a page."""
    uncoded = _uncoded(text) if text else ""
    if not _kinds(uncoded):
        return []  # none in the whole text: none in what is left of it
    gone = shared_lines(text.split("\n"), others)
    return _kinds("\n".join(x for i, x in enumerate(uncoded.split("\n")) if i not in gone))


def markup_kinds(pages: DataFrame) -> DataFrame:
    """(page_id, markup) of the kinds of markup in each page's lines, after differencing."""
    found = _differenced(pages, lambda i, t, others: (i, left_kinds(t, others)), "page_id long, k array<string>")
    return found.where(F.size("k") > 0).select("page_id", F.explode("k").alias("markup")).distinct()


_tag = re.compile(rf"</?(?:{TAGS})(?:\s[^<>]*)?/?>|<!doctype[^>]*>", re.I)
_comment = re.compile(r"<!--.*?(?:-->|\Z)", re.S)


def _inline(t: str) -> str:
    """One stretch of text outside code, without markup."""
    if "<" in t:
        t = _comment.sub("", t)
    for _ in range(3):  # escaped entities and tags
        u = unescape(t) if "&" in t else t
        if u == t:
            break
        t = u
    if "<" in t:
        t = _comment.sub("", t)
        t = re.sub(r"(?i)<h([1-6])(?:\s[^<>]*)?>", lambda m: "\n" + "#" * int(m[1]) + " ", t)
        t = re.sub(r"(?i)<li(?:\s[^<>]*)?>", "\n* ", t)
        t = re.sub(r"(?i)</?(?:p|div|h[1-6]|ul|ol|table|tr|section|article|blockquote|pre)(?:\s[^<>]*)?>", "\n", t)
        t = re.sub(r"(?i)<br(?:\s[^<>]*)?/?>", " ", t)
        t = _tag.sub("", t)
    # wiki
    if "==" in t:
        t = re.sub(r"(?m)^[ \t]*(={2,6})[ \t]*([^=\s\d][^=\n]*?)[ \t]*={2,6}[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], t)
    if "[[" in t:
        t = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo|ファイル):[^\[\]|]*((?:\|[^\[\]|]*)*)\]\]", lambda m: m[1].rsplit("|", 1)[-1] if "|" in m[1] else "", t)
        t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", t)
    if "[http" in t:
        t = re.sub(r"\[https?://[^\s\]]+ ([^\]\n]+)\](?!\()", r"\1", t)
    if "''" in t:
        t = re.sub(r"(?<![\w'])'''?(?=[^\s'])([^\n]*?[^\s'])'''?(?!')", r"\1", t)
    if "|" in t:
        t = re.sub(r"(?m)^[ \t]*(?:\{\|.*|\|\}|\|-+)[ \t]*\n?", "", t)
        t = re.sub(r"(?m)^[ \t]*\|[ \t]*(.*\|\|.*)$", lambda m: "| " + m[1].replace("||", "|") + " |", t)
    # latex: sections, lists and emphasis become Markdown, formulas stay
    if "\\" in t:
        t = re.sub(r"\\(section|subsection|subsubsection|chapter|title)\*?\{([^{}]*)\}", lambda m: {"section": "## ", "subsection": "### ", "subsubsection": "#### "}.get(m[1], "# ") + m[2], t)
        t = re.sub(r"\\(?:begin|end)\{(?:itemize|enumerate|center|document|quote|figure|table|abstract)\*?\}(?:\[[^\]]*\])?[ \t]*\n?", "", t)
        t = re.sub(r"(?m)^[ \t]*\\item\b[ \t]*", "* ", t)
        t = re.sub(r"[ ~]?\((?:see )?\\(?:ref|eqref|autoref)\{[^{}]*\}\)|~?\\(?:cite|citep|citet|ref|eqref|label|footnote|pageref)(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
        parts = re.split(r"(\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*\$(?![\w$])|\\\([^\n]+?\\\)|\\begin\{(?:equation|align)\*?\}.*?\\end\{(?:equation|align)\*?\})", t, flags=re.S)
        for i in range(0, len(parts), 2):
            for _ in range(3):
                parts[i] = re.sub(r"(?<![A-Za-z]:)(?<![\w\\])\\(?:emph|textbf|textit|texttt|underline|text|textsc|mbox|url|href)\*?\{([^{}]*)\}", r"\1", parts[i])
        t = "".join(parts)
    return t


def clean(text: str | None) -> str:
    """Clean text; fenced and inline code stay as they are."""
    if not text:
        return ""
    out, at = [], 0
    for m in CODE.finditer(text):
        out += [_inline(text[at : m.start()]), m.group()]
        at = m.end()
    out.append(_inline(text[at:]))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", "".join(out))).strip("\n")


def clean_pages(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(page_id, clean_text): each page's own lines, without markup."""
    rules = learned(pages) if rules is None else rules

    def one(i, t, others):
        if not t:
            return i, ""
        lines = t.split("\n")
        return i, clean("\n".join(lines[j] for j in own_lines(rules, t, others)))

    return _differenced(pages, one, "page_id long, clean_text string").groupBy("page_id").agg(F.min("clean_text").alias("clean_text"))


_drop = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head)\b.*?(?:</\1\s*>|\Z)")
_pre = re.compile(r"(?is)<pre\b[^>]*>(.*?)(?:</pre\s*>|\Z)")
_code = re.compile(r"(?is)<code\b[^>]*>(.*?)</code\s*>")


def clean_html(body: str | None) -> str:
    """Clean text of an HTML body; null gives an empty text, a body that is no HTML stays as it is."""
    if not body:
        return ""
    if "<" not in body:
        return body
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    t = _drop.sub(" ", body)
    t = _pre.sub(lambda m: keep("\n```\n" + unescape(_tag.sub("", m[1])).strip("\n") + "\n```\n"), t)
    t = _code.sub(lambda m: keep("`" + unescape(_tag.sub("", m[1])) + "`"), t)
    t = re.sub(r"\s+", " ", t)
    t = _inline(t)
    t = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], t)
    lines = [x.strip() if not x.startswith("```") else x for x in t.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def clean_responses(responses: DataFrame) -> DataFrame:
    """(response_id, clean_text) of every answer."""

    def rows(ids, bodies):
        return ((i, clean_html(b)) for i, b in zip(ids, bodies) if i is not None)

    return map_arrow(responses.select("response_id", "body"), rows, "response_id long, clean_text string").groupBy("response_id").agg(F.min("clean_text").alias("clean_text"))
