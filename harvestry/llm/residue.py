"""Problem 1: template residue, error pages, filler text and script notices.

Method: placeholder detectors work on the title and on the text outside code.  For
the rest, a page of low information - nothing of its own but short lines - is held
against its address slug and title, and against all hosts: each of its lines, with
figures, paths and addresses levelled, is counted over the pages, hosts and names
(slug and title) it stands under and over the names it does not answer to.  A line
speaks against its page if error, filler or notice terms are in it and the page
does not answer to its address and title, or the line stands under several names
it does not answer to; and, whatever its wording, if it stands under so many names
and hosts that it can be none's own.  A page is a case if such lines are nearly
all it has.

Scale: one narrow pass; only lines of low-information pages, as hashes, are
shuffled, and they are counted by (line, site, name) with a partial aggregate
first.

Defined cases: null title or url counts as empty; an empty or null body is no
case unless the title shows a placeholder; repeated rows give one row; rows
without page_id are left out; texts of any length are read whole; two rows of one
page_id are judged each by itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLANKS, HOMELINK, LINK, TITLE, Rules, block, is_fence, learned
from .messages import ERROR, SAMPLE, hit
from .text import map_arrow, saved, site_of, without_code

_F = r"[A-Za-z][A-Za-z0-9]*(?:[ ._-][A-Za-z0-9]+){0,3}"
# Shapes of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[A-Za-z_][\w .-]*(?:\|\s*\w+\s*)*\}?\}\}"
    rf"|\{{%-?\s*{_F}\s*-?%\}}|\[%-?\s*{_F}\s*-?%\]|<%=?\s*{_F}\s*%>"
    r"|%%[A-Za-z][A-Za-z ._]*%%|(?<![\w%])%[A-Z][A-Z_.]{2,}%|@@[A-Za-z][A-Za-z ._]*@@|(?<![\w_])__[A-Z][A-Z _.]*[A-Z]__(?![\w_])|XX[A-Z][A-Z _.]+?XX"
    r"|[$#]\{\s*[A-Za-z_][\w.]*\s*\}|%\([A-Za-z_][\w.]*\)[sd]"
    r"|(?<![\w}\\$#{^_])\{[a-z][a-z]+(?:[._][a-z]+)*\}(?!\})"
    rf"|\[(?:INSERT|YOUR|ENTER|ADD) [A-Z][A-Z _.]*\](?!\()|\[(?:Your|Insert|Enter) {_F}(?: here)?\](?!\()|\[{_F} - to be supplied\]|\({_F} goes here\)"
)

# Words of titles that name no content.
GENERIC = frozenset(
    "error errors fehler erreur page pages seite página requests loading untitled document home homepage startseite accueil inicio welcome willkommen bienvenue sample default title moment please found denied access forbidden maintenance wartung unavailable server website exception problem sorry oops notfound ladevorgang chargement cargando".split()
)
_server = re.compile(r"[\w.-]+/\d[\d.]*|[\w ]*\d{3}[\w ]*")
_sentence = re.compile(r"(?<=[.!?。！？])\s*")
_w = re.compile(r"[^\W_]+")
_digits = re.compile(r"\d+")
_lead = re.compile(r"^(?:[*+•-]|#{1,6}|\d{1,3}[.)])\s+")
_path = re.compile(r"[^\s\"'(]*[^\s\"'(.][/.](?=\w)[^\s\"')]*|/\w[^\s\"')]*|\w+\(\)")
_address = re.compile(r"https?://|(?<!\w)#\w|^(?:\S*\s)?\S*\d{4,}$")
_stop = re.compile(r"[.!?…。！？:：][\"'”’»)\]]*$")


_hint = re.compile(r"[{%@]|__|XX|\[(?:INSERT|YOUR|ENTER|ADD|Your|Insert|Enter) | to be supplied\]| goes here\)|<%")


def has_placeholder(title: str | None, markdown: str | None) -> bool:
    return any(t and _hint.search(t) and PLACEHOLDER.search(without_code(t)) for t in (title, markdown))


def core(rules: Rules, markdown: str | None) -> tuple[list[str], list[str]]:
    """Own lines of the page without blank lines: headings of level 1, and the rest (a link to the front page aside)."""
    lines = (markdown or "").split("\n")
    heads, rest = [], []
    for x, bad in zip(lines, rules.furniture(lines)):
        b = None if bad else block(x)
        if b is None:
            continue
        s = BLANKS.sub(" ", x).strip()
        if b.kind == TITLE:
            heads.append(s.lstrip("# "))
        elif b.kind != HOMELINK:
            rest.append(s)
    return heads, rest


def _terms(url: str | None, title: str | None) -> tuple[set[str], set[str]]:
    slug = {w for w in _w.findall((url or "").rstrip("/").rpartition("/")[2].lower()) if len(w) > 4 and not w.isdigit()}
    low = (title or "").lower()
    words = _w.findall(low)
    name = set() if ERROR.search(low) or SAMPLE.search(low) else {w for w in words if len(w) > 4 and not w.isdigit()}
    return slug - GENERIC, name - GENERIC


def terms_met(url: str | None, title: str | None, text: str) -> tuple[int, int]:
    """How many terms of the address slug, and of the title, the body takes up."""
    body = set(_w.findall(text.lower()))
    slug, name = _terms(url, title)
    return len(slug & body), len(name & body)


def level(line: str) -> str:
    """The line as it is counted: lower case, without marker, figures, paths, addresses and names of functions levelled."""
    return _digits.sub("0", _path.sub("§", _lead.sub("", line.lower())))


def speaks(rules: Rules, markdown: str) -> bool:
    """Whether a long line is content whatever stands around it and is neither filler nor an error's.

    Such a page is not of low information, so that most pages are done without the second pass over their blocks.
    """
    return any(len(x) > 60 and rules.tells(x) and _says_else(x) for x in markdown.split("\n"))


def _says_else(line: str) -> bool:
    """said(line) < 0.8, without going on when that is clear."""
    parts = [y for y in _sentence.split(line) if y]
    rest = 0.2 * sum(map(len, parts))
    for y in parts:
        if not hit(y):
            rest -= len(y)
            if rest < -1e-9:
                return True
    return False


def said(line: str) -> float:
    """Share of a line that its sentences with residue terms have."""
    parts = [y for y in _sentence.split(line) if y]
    return sum(len(y) for y in parts if hit(y)) / max(1, sum(map(len, parts)))


Line = tuple[str, int, str]


def judge(rules: Rules, url: str | None, title: str | None, markdown: str | None) -> tuple[str, list[Line], bool, int, int]:
    """(reason, lines, off, slug terms met, title terms met).

    reason is "placeholder" where the page is a case by itself; lines are (levelled text, size, kind of terms) of a page of
    low information, and off tells that it has a slug or title and takes up nothing of them.
    """
    none = ("", [], False, 0, 0)
    if has_placeholder(title, markdown):
        return "placeholder", [], False, 0, 0
    if not markdown or speaks(rules, markdown):
        return none
    heads, rest = core(rules, markdown)
    if any(is_fence(x) for x in rest):
        return none
    own = rest or [h for h in heads if hit(h)]
    lines, said_by = [], []
    for x in own:
        b = block(x)
        kind = hit(x) if said(x) >= (0.8 if b is not None and b.long else 0.4) else ""
        mark = _lead.match(x)
        # Links, addresses and items that are no sentences are nobody's message, however often they come back.
        if kind or not (LINK.search(x) or _address.search(x) or mark and not _stop.search(x)):
            key = level(x)
            if not kind and _server.fullmatch(x):
                kind = "error" if any(hit(y) == "error" for y in own) else ""
            lines.append((key, len(x), kind))
        else:
            lines.append(("", len(x), ""))
        said_by.append(x)
    if not lines or sum(n for k, n, _ in lines if k) < 0.8 * sum(n for _, n, _ in lines):
        return none
    slug, name = terms_met(url, title, " ".join(said_by))
    return "", lines, not slug and not name, slug, name


def _suspects(pages: DataFrame, rules: Rules) -> DataFrame:
    """Cases by placeholder and pages of low information with their lines as 64-bit hashes: written once, since used twice.

    name is the page's slug and title; named tells that they have terms to answer to.
    """

    def rows(ids, urls, titles, texts, sites):
        for i, u, t, x, s in zip(ids, urls, titles, texts, sites):
            if i is not None:
                why, lines, off, slug, name = judge(rules, u, t, x)
                if why or lines:
                    named = any(_terms(u, t))
                    yield i, s, why, off, named, slug, name, f"{(u or '').rstrip('/').rpartition('/')[2]} {t or ''}", [{"key": k, "size": n, "kind": w} for k, n, w in lines]

    src = pages.select("page_id", "url", "title", "markdown_ir", site_of("url").alias("site"))
    found = map_arrow(src, rows, "page_id long, site string, reason string, off boolean, named boolean, slug int, title int, name string, lines array<struct<key:string,size:int,kind:string>>")
    hashed = F.transform("lines", lambda x: F.struct(F.when(x["key"] != "", F.xxhash64(x["key"])).alias("key"), x["size"].alias("size"), x["kind"].alias("kind")))
    return saved(found.withColumn("lines", hashed).withColumn("name", F.xxhash64("name")).distinct())


def _standing(found: DataFrame) -> DataFrame:
    """(key, pages, hosts, names, strays): where a line stands; names are different slugs and titles, strays those it does not answer to.

    Counted per (line, site, name) first, so that a line on most pages of a host is spread over its names.
    """
    lines = found.select("page_id", "site", "name", (F.col("off") & F.col("named")).alias("off"), F.explode("lines").alias("l")).select("page_id", "site", "name", "off", F.col("l.key").alias("key")).where("key is not null")
    part = lines.groupBy("key", "site", "name").agg(F.countDistinct("page_id").alias("n"), F.min("off").alias("off"))
    part = part.groupBy("key", "name").agg(F.sum("n").alias("n"), F.min("off").alias("off"), F.collect_set("site").alias("sites"))
    # a name stands on few sites; sites of a line are counted over them
    sites = part.select("key", F.explode_outer("sites").alias("site")).groupBy("key").agg(F.countDistinct("site").alias("hosts"))
    counts = part.groupBy("key").agg(F.sum("n").alias("pages"), F.count("*").alias("names"), F.sum(F.col("off").cast("int")).alias("strays"))
    return counts.join(sites, "key")


#: A line of no listed terms is nobody's own if it stands under so many names it does not answer to; each further host is worth a name.
_message = "names + hosts >= 6 and strays >= 3 and strays >= 0.9 * names"
#: Share of a page's own text that lines that speak against it must have.
_share = 0.8


def _judged(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(page_id, reason, off, slug, title, said, against, pages, hosts) of every suspect, said and against being sizes of text."""
    found = _suspects(pages, learned(pages) if rules is None else rules)
    lines = found.where("reason = ''").select("page_id", "site", "name", "off", "slug", "title", F.posexplode("lines").alias("at", "l")).select("page_id", "site", "name", "off", "slug", "title", "at", "l.*")
    both = lines.join(_standing(found), "key", "left")
    against = F.expr(f"(kind <> '' and (off or strays >= 2)) or coalesce({_message}, false)")
    by = both.groupBy("page_id", "site", "name", "off", "slug", "title").agg(
        F.sum("size").alias("said"),
        F.sum(F.when(against, F.col("size")).otherwise(0)).alias("against"),
        F.max_by("kind", F.when(F.col("kind") != "", F.col("size")).otherwise(0)).alias("kind"),
        F.max(F.coalesce("pages", F.lit(0))).alias("pages"),
        F.max(F.coalesce("hosts", F.lit(0))).alias("hosts"),
    )
    by = by.select("page_id", F.when(F.col("kind") == "", "message").otherwise(F.col("kind")).alias("reason"), "off", "slug", "title", "said", "against", "pages", "hosts")
    zero = F.lit(0).cast("long")
    own = found.where("reason = 'placeholder'").select("page_id", "reason", "off", "slug", "title", F.lit(1).cast("long").alias("said"), F.lit(1).cast("long").alias("against"), zero.alias("pages"), zero.alias("hosts"))
    return by.union(own)


def template_residue(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """page_id of every page that shows residue instead of content."""
    return _judged(pages, rules).where(F.col("against") >= F.col("said") * F.lit(_share)).select("page_id").distinct()


def evidence(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(page_id, reason, residue, slug_terms, title_terms, same_line_pages, same_line_hosts): what speaks against each suspect.

    residue tells whether the page is a case; slug_terms and title_terms: how many of them the body takes up; same_line_*: on
    how many pages and hosts the most frequent of its lines stands.  The reason "message" has only where its lines stand.
    """
    out = _judged(pages, rules)
    case = (F.col("against") >= F.col("said") * F.lit(_share)).alias("residue")
    return out.select("page_id", "reason", case, F.col("slug").alias("slug_terms"), F.col("title").alias("title_terms"), F.col("pages").alias("same_line_pages"), F.col("hosts").alias("same_line_hosts")).distinct()


def by_itself(rules: Rules, url: str | None, title: str | None, markdown: str | None) -> bool:
    """Whether a page is a case whatever stands on others: a placeholder, or residue terms and nothing of its address and title."""
    why, lines, off, _, _ = judge(rules, url, title, markdown)
    return bool(why) or bool(lines) and off and sum(n for _, n, kind in lines if kind) >= _share * sum(n for _, n, _ in lines)
