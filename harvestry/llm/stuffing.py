"""Problem 2: keyword-stuffed pages and link lists.

Method: over the positions of a page's terms without function words, lag windows
give the gaps at which terms come back and the autocorrelation of "the same term
stands k positions on" (k up to 24 and any longer gap at which a tenth of the
terms come back; up to 8 over the shapes of its lines or entries).  A lag whose
autocorrelation lies well over chance is a regular one.  Unnaturally regular recurrence is stuffing;
so is a high share of distinct nouns, links, addresses or tags without function
words.  What saves a page is text: more than one real sentence, or entries
described in sentences; a sentence many of whose terms come back in it at regular
lags is not real, whatever its function words.

Defined cases: null or empty markdown_ir is no case; pages with residue
(problem 1) are none; repeated rows give one row; rows without page_id are left
out; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .blocks import BLANKS, LINK, STOP, Rules, is_fence, learned
from .residue import core, hit, judge
from .text import map_arrow

_w = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_unit = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？])[」』）]*")
_address = re.compile(r"https?://\S+|(?<!\w)#\w+|\b(?:tag|sku\d*|schlagwort|etiqueta|mot-clé)\s*:?", re.I)
_split = re.compile(r"\s*[•·/|;,、，：:()\[\]]+\s*|\s{2,}|\s+-\s+")
_mark = re.compile(r"(?:[*•-]|#{1,6}|\d{1,3}[.)])\s+")
_kana = re.compile(r"[ぁ-ゖ]")
_particle = re.compile(r"[はがをにでとのもへ]")
_cjk = re.compile(r"[぀-ヿ一-鿿]")
_run = re.compile(r"[ァ-ヶー]+|[一-鿿]+|[ぁ-ゖ]+|[^\W_ァ-ヶー一-鿿ぁ-ゖ]+(?:['’][^\W_]+)*")
_end = re.compile(r"[.!?…。！？][\"'”’»」』)]*\s*$")
LAGS = 24
#: An autocorrelation that natural text does not reach over several terms; the share of a sentence's terms at regular places
#: from which it is no real one.
REGULAR, STUFFED = 0.08, 0.4
#: Function words that shopping phrases also use.
WEAK = frozenset("pas en plus no on".split())


def sentence_like(unit: str) -> bool:
    """A real sentence: words held together by function words (or kana particles), with an end or of some length."""
    if _cjk.search(unit):
        kana = len(_kana.findall(unit))
        return len(unit) >= (8 if _end.search(unit) else 16) and kana >= 3 and len(set(_particle.findall(unit))) >= 2 and kana / len(unit) >= 0.18
    words = [w.lower() for w in _w.findall(unit)]
    if len(words) < (4 if _end.search(unit) else 9):
        return False
    stops = sum(w in STOP and w not in WEAK for w in words)
    return stops >= 2 and stops / len(words) >= 0.18


def _long_gaps(terms: list[str]) -> list[int]:
    """Gaps of over LAGS positions between a term and its last place that at least five terms and a tenth of them have."""
    last: dict[str, int] = {}
    gaps = Counter()
    for i, t in enumerate(terms):
        gaps[i - last.get(t, i)] += 1
        last[t] = i
    return [k for k, c in gaps.items() if k > LAGS and c >= max(5, 0.1 * len(terms))]


def recurrence(terms: list[str]) -> tuple[list[int], float, float, float]:
    """The regular lags, the share of terms that come back at one of the lags, the highest autocorrelation over the lags, and
    the share of distinct terms.

    Lags are those up to LAGS, and the longer gaps to a term's last place that a tenth of the terms have; a regular one has an
    autocorrelation of at least REGULAR over chance.
    """
    n = len(terms)
    if n < 2:
        return [], 0.0, 0.0, 1.0
    back = np.zeros(n, bool)
    ids = {}
    a = np.fromiter((ids.setdefault(t, len(ids)) for t in terms), np.int32, n)
    top, regular = 0.0, []
    chance = float(np.square(np.bincount(a) / n).sum())
    for k in [*range(1, min(LAGS, n - 1) + 1), *_long_gaps(terms)]:
        eq = a[k:] == a[:-k]
        over = (float(eq.mean()) - chance) / max(1e-9, 1 - chance)
        top = max(top, over)
        back[k:] |= eq
        if over >= REGULAR and int(eq.sum()) >= 4:
            regular.append(k)
    return regular, float(back.mean()), top, len(ids) / n


def real_sentences(spans: list[tuple[int, int]], terms: list[str], regular: list[int]) -> int:
    """How many sentences, as spans of terms, are real: under STUFFED of their terms come back at regular lags within them."""
    real = 0
    for a, z in spans:
        own = terms[a:z]
        at = set()
        for k in regular:
            for i in range(len(own) - k):
                if own[i] == own[i + k]:
                    at |= {i, i + k}
        real += not (own and len(at) >= STUFFED * len(own))
    return real


def shapes(lines: list[str]) -> float:
    """Autocorrelation, over lags up to 8, of the lines' shapes (link, item, address, text)."""
    kind = ["l" if LINK.sub("", x).strip(" *-•") == "" else "a" if _address.match(x) else "i" if x[:2] in ("* ", "- ") else "t" for x in lines]
    n = len(kind)
    return max((sum(kind[i] == kind[i - k] for i in range(k, n)) / (n - k) for k in range(1, min(8, n - 1) + 1)), default=0.0)


def _own_terms(low: str) -> list[str]:
    return [w for w in _run.findall(low) if not w.isdigit() and w not in STOP]


def tells(rules: Rules, markdown: str) -> bool:
    """Whether lines that are own content whatever stands around them hold over one sentence that is real at any lag: then no
    second pass is needed."""
    real = 0
    for x in markdown.split("\n"):
        if len(x) > 60 and rules.tells(x):
            plain = _mark.sub("", LINK.sub(r"\1", BLANKS.sub(" ", x).strip()))
            if not _address.match(plain):
                for u in _unit.split(plain):
                    if sentence_like(u):
                        own = _own_terms(u.lower())
                        times = Counter(own)
                        real += sum(c for c in times.values() if c > 1) < STUFFED * max(1, len(own))
                        if real > 1:
                            return True
    return False


def stuffed(rules: Rules, url: str | None, title: str | None, markdown: str | None) -> bool:
    if not markdown or tells(rules, markdown):
        return False
    _, lines = core(rules, markdown)
    if not lines or any(is_fence(x) for x in lines):
        return False
    plain = [_mark.sub("", LINK.sub(r"\1", x)) for x in lines]
    words = stops = 0
    terms: list[str] = []
    spans: list[tuple[int, int]] = []
    for x in plain:
        units = [x] if _address.match(x) else _unit.split(x)
        for u in units:
            for w in _run.findall(_address.sub(" ", u).lower()):
                if not w.isdigit():
                    words += 1
                    stops += w in STOP and w not in WEAK
            own = _own_terms(_address.sub(" ", u).lower())
            if not _address.match(x) and sentence_like(u):
                spans.append((len(terms), len(terms) + len(own)))
            terms += own
    regular, back, top, distinct = recurrence(terms)
    if real_sentences(spans, terms, regular) > 1:
        return False
    addresses = sum(len(_address.findall(y)) or bool(LINK.search(y)) for y in lines)
    entries = sum(len([e for e in (x.split() if _cjk.search(x) else _split.split(x)) if e]) for x in plain)
    if words + addresses < 8:
        return False
    if addresses < 5 and words and stops / words > 0.22 and not regular:
        return False
    bare = addresses >= 0.5 * len(lines) or shapes(lines) >= 0.6 and len(lines) >= 5
    stuffy = back >= 0.3 or top >= 0.05 or distinct >= 0.5 and entries >= 8
    if not (bare or stuffy):
        return False
    # lines of error, filler and notice terms are problem 1's
    residue = sum(len(x) for x in lines if hit(x))
    return residue < 0.5 * sum(map(len, lines)) and judge(rules, url, title, markdown)[0] != "placeholder"


def keyword_pages(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """page_id of every page that is keywords, links, addresses or tags.  One narrow pass; only ids are shuffled."""
    rules = learned(pages) if rules is None else rules

    def rows(ids, urls, titles, texts):
        return ((i,) for i, u, t, x in zip(ids, urls, titles, texts) if i is not None and stuffed(rules, u, t, x))

    return map_arrow(pages.select("page_id", "url", "title", "markdown_ir"), rows, "page_id long").distinct()
