"""Problem 10: sentence units across languages and scripts.

Method: the standard character-property rules of sentence breaking (terminators
of all scripts, closing marks kept, no break before lower case after a full
stop), with suppression of abbreviations by language, quotations and parentheses
taken as wholes, and the layouts the project's data has: an empty line ends a
unit, a single line break is white space, except before a list item, and a
heading or list item is one unit.  In Thai a blank between two Thai words ends a
sentence; one beside a number or a foreign name does not, except after a year.

Defined cases: null and empty texts have no units; rows without doc_id are left
out; repeated rows give one row; a text of any length is read whole; quotation
marks without a partner are plain characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_arrow

# Characters whose Sentence_Break property is STerm, of all scripts; full stops (ATerm) need a look around.
STERM = "".join(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))) if regex.match(r"\p{Sentence_Break=STerm}", c)) + "．"
#: Those that end a sentence without a blank after them.
WIDE = frozenset(STERM) - frozenset("!?‼‽⁇⁈⁉⸮")
_event = re.compile(rf"[.…{re.escape(STERM)}]+|[\"“”„«»「『《(（【〈]")
# Marks that close.  Those that open as well count only where a blank or nothing follows; pairs are taken as wholes before.
_close = re.compile(r"(?:[”’»」』》)）】〉\]]|[\"](?=\s|$))*")
CLOSER = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "(": ")", "（": "）", "”": "”"}
PAREN = frozenset("(（【")
TITLE_MARKS = frozenset("《〈")

# Abbreviations no sentence ends in, whatever follows.
NEVER = frozenset(
    "dr prof sen rep gov pres mr mrs ms mme mmes mlle mgr me mt st ste sr sra srta dra d ing rev hon gen col capt lt sgt jr vs viz cf e.g i.e esp incl resp"
    " fa hr fr frl bzw vgl z.b d.h u.a u.u o.ä z.t sog ggf inkl"
    " p.ex c.-à-d av bd"
    " p.ej ee ud uds dña"
    " проф акад им ул г-н г-жа т.е т.к см ср напр"
    " डॉ श्री प्रो د أ م ص".split()
) - {"d", "me", "fr", "ste"}
# Abbreviations that go with a number after them.
NUMBER = frozenset("eq eqs no nos nr nrn n fig figs abb sec secs art arts p pp pag pág págs vol vols ed ch chap kap bd par ext est approx ca c circa tel рис стр табл гл ч п № รูป".split())
MONTHS_DE = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Apr|Aug|Sept?|Okt|Nov|Dez)\b")
SPEECH = re.compile(
    r"\b(?:said|asked|wrote|replied|added|answered|noted|cried|called|explained|says|asks|sagte|fragte|rief|meinte|schrieb|erklärte|dit|demande|demanda|répondit|dijo|preguntó|respondió|сказал|сказала|спросил|спросила|ответил)\b|कहा|पूछा|बोल|说|問|问|道|写|話し|言っ|尋ね|قال|سأل|กล่าว|ถาม|บอก"
)
# Words that go with a country's initials before them.
INSTITUTIONS = frozenset("Senate Congress House Army Navy Air Marine Marines Coast Supreme Court District Government Department President Treasury Constitution Embassy Ambassador Attorney Secretary Forces Dollar Dollars Open Census Postal Citizen Citizens".split())
#: Characters before a full stop that can matter: no abbreviation is longer.
_LOOK = 2 + max(map(len, NEVER | NUMBER))
_item = re.compile(r"[ \t　]*(?:[-*•‣▪◦]|\(?(\d{1,3})[.)])[ \t　]+(?=\S)")
_empty = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_before = re.compile(r"[\w'’№-]+(?:\. ?[\w'’]+)*$")
_tail_word = re.compile(r"[^\W\d_][\w'’-]*$")
_odd = re.compile(r"[a-zà-ÿ]+[A-Z]\w*|[a-z][\w-]*\.[a-z]{2,4}\b|https?://|www\.")
_first_word = re.compile(r"\w+")
_clause = re.compile(r"[^。！？.!?，、,;:]*")
_thai = re.compile(r"[฀-๿]")
_pair = re.compile(r"(?:z\.\s*B|z\.\s*T|d\.\s*h|u\.\s*a|o\.\s*ä|p\.\s*ex|p\.\s*ej|т\.\s*е|т\.\s*к|т\.\s*д|т\.\s*п|EE\.\s*UU|p\.\s*m|a\.\s*m)\.")
_multi = re.compile(r"(?:^|[\s(])(т\.\s*е|т\.\s*к|z\.\s*B|d\.\s*h|u\.\s*a|o\.\s*ä|z\.\s*T|p\.\s*ex|p\.\s*ej|i\. ?e|e\. ?g|c\.-à-d)$")
# Abbreviations whose letters carry vowel signs.
_marked = re.compile(r"(?:^|[\s(“])(?:डॉ|श्री|प्रो|सुश्री|पं)$")


def _caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def _stop_ends(t: str, i: int, j: int, unit: int = 0) -> bool:
    """Whether the full stop at t[i:j] (followed by white space or more text) ends a sentence; t is one paragraph."""
    n = len(t)
    k = j
    while k < n and t[k].isspace():
        k += 1
    if k >= n:
        return True
    c = t[k]
    tight = k == j
    word = _before.search(t, max(0, i - _LOOK), i)
    w = word.group() if word else ""
    last = _tail_word.search(w)
    last = last.group() if last else ""
    if tight and (t[i] == "…" or i > 0 and t[i - 1].isdigit() and c.isdigit()):
        return t[i] == "…" and c.isupper()
    if tight:
        # no blank: a decimal, an address, a file name - or a blank left out between sentences
        token = t[max(0, t.rfind(" ", 0, i), t.rfind("\n", 0, i)) + 1 : i]
        if "/" in token or "@" in token or "." in token:
            return False
        if len(last) >= 3 and last.lower() not in NUMBER and last.lower() not in NEVER:
            if c.isdigit():
                return True
            if c.isupper() and last[-1].islower():
                return True
            if c in "«„“¿¡»\"" and last[-1].isalpha():
                return True
            if _caseless(c) and _caseless(last[-1]):
                return True
        return bool(c.isupper() and token.isdigit() and len(token) == 4) or bool(token[-1:].isdigit() and (_caseless(c) or c.isupper()) and len(token) >= 4)
    if t[i:j].strip(".…") == "" and (j - i > 1 or t[i] == "…"):
        return not c.islower() or bool(_odd.match(t, k)) and i > 0 and not t[i - 1].isspace()
    if c.islower():
        return bool(_odd.match(t, k)) and last.lower() not in NEVER and last.lower() not in NUMBER and not _multi.search(t, max(0, i - 8), i)
    if c in "—–-,;:" and not (c == "-" and k + 1 < n and t[k + 1].isdigit()):
        m = k + 1
        while m < n and t[m].isspace():
            m += 1
        return not (m < n and t[m].islower()) and c not in ",;:"
    low = re.split("['’]", last.lower())[-1] if "'" in last or "’" in last else last.lower()
    if w and w[-1].isdigit() and not last:
        digits = re.search(r"\d+$", w).group()
        return not (len(digits) <= 2 and MONTHS_DE.match(t, k))
    if _multi.search(t, max(0, i - 8), i) or _pair.match(t, i - len(last)):
        return False
    if len(last) == 1:
        start = i - 1
        alone = start <= unit or t[start - 1].isspace() or t[start - 1] in "(\"“„«"
        if alone and (last.isupper() or _caseless(last)):
            return False
        if not alone and last.isupper() and t[start - 1] == "." and start > 1 and t[start - 2].isupper() and c.isupper():
            # initials end a sentence unless the next word goes with them
            m = _first_word.match(t, k)
            return not (m and m.group() in INSTITUTIONS)
    if low in NEVER and (len(low) > 1 or _caseless(low)):
        return False
    if _marked.search(t, max(0, i - 6), i):
        return False
    if low in NUMBER and c.isdigit():
        return False
    if low == "co" and t.startswith(("KG", "Kg", "OHG"), k):
        return False
    return True


def _mark_ends(t: str, i: int, j: int) -> bool:
    """The same for a question or exclamation mark."""
    n, k = len(t), j
    while k < n and t[k].isspace():
        k += 1
    if k >= n:
        return True
    c = t[k]
    if k == j:
        if any(x in WIDE for x in t[i:j]):
            return True
        token = t[max(0, t.rfind(" ", 0, i), t.rfind("\n", 0, i)) + 1 : i]
        return "/" not in token and i > 0 and t[i - 1].isalpha() and (c.isupper() or c.isdigit() or _caseless(c) or c in "¿¡«„“")
    if any(x in WIDE for x in t[i:j]):
        return True
    if c.islower():
        return bool(_odd.match(t, k))
    return c not in ",;:"


def _pairs(t: str, c: str) -> dict[int, int]:
    """Places of the opening marks c with those of their closing marks."""
    out, held = {}, []
    for m in re.finditer(f"[{re.escape(c + CLOSER[c])}]", t):
        if m.group() == c:
            held.append(m.start())
        elif held:
            out[held.pop()] = m.start()
    return out


def _prose(t: str, base: int) -> Iterator[tuple[int, int]]:
    """Sentence units of one paragraph (no list items), as offsets with base added."""
    n, start, at = len(t), 0, 0

    def skip(k: int) -> int:
        while k < n and t[k].isspace():
            k += 1
        return k

    places: dict[str, int] = {}
    pairs: dict[str, dict[int, int]] = {}

    def closing(x: str, j: int) -> int:
        """The next place of x from j on, or -1; each stretch of the text is searched once."""
        p = places.get(x, -2)
        if p == -2 or 0 <= p < j:
            p = places[x] = t.find(x, j)
        return p

    start = skip(0)
    while at < n:
        m = _event.search(t, at)
        if not m:
            break
        i, j = m.span()
        c = t[i]
        if c in CLOSER:
            if c == '"' and not (j < n and not t[j].isspace() and (i == 0 or t[i - 1].isspace() or t[i - 1] in "(:—–「（«“")):
                if not (i == 0 or not t[i - 1].isascii()):
                    at = j
                    continue
            if c in "”":
                at = j
                continue
            ends = [p for p in (closing(x, j) for x in CLOSER[c]) if p >= 0]
            if not ends:
                at = j
                continue
            e = min(ends)
            if c in PAREN:
                if c not in pairs:
                    pairs[c] = _pairs(t, c)
                if i not in pairs[c]:
                    at = j
                    continue
                e = pairs[c][i]
            inner = t[j:e].rstrip()
            ended = bool(inner) and (inner[-1] in STERM or inner[-1] in ".…")
            first = i <= start or not t[start:i].strip("¿¡ \n\t\"“„«(")
            at = e + 1
            k = skip(at)
            if c in TITLE_MARKS or not ended or k >= n:
                continue
            x = t[k]
            if x.islower() or x in ",;:—–.!?…。，、-" or "ぁ" <= x <= "ゖ":
                continue
            if c in PAREN:
                if not first:
                    continue
            elif first:
                if k == at and (x.isalpha() or x.isdigit()):
                    continue
                if SPEECH.search(" ".join(_clause.match(t, k).group().split()[:4])):
                    continue
            yield base + start, base + at
            start = at = k
            continue
        if c == "." or c == "…":
            ok = (any(x in STERM for x in t[i:j]) and _mark_ends(t, i, j)) or _stop_ends(t, i, j, start)
        else:
            ok = _mark_ends(t, i, j)
        at = j
        if ok:
            e = _close.match(t, j).end()
            yield base + start, base + e
            start = at = skip(e)
    if start < n:
        e = n
        while e > start and t[e - 1].isspace():
            e -= 1
        if e > start:
            yield base + start, base + e


def _thai_parts(t: str, s: int, e: int) -> Iterator[tuple[int, int]]:
    """A unit with Thai in it, cut at the blanks that end sentences."""
    start, depth, i = s, 0, s
    while i < e:
        c = t[i]
        if c in "“„(«":
            depth += 1
        elif c in "”)»" and depth:
            depth -= 1
        if c.isspace() and not depth:
            j = i
            while j < e and t[j].isspace():
                j += 1
            a, b = t[i - 1], t[j] if j < e else ""
            ta, tb = "฀" <= a <= "๿", "฀" <= b <= "๿"
            cut = False
            if b and a in "”»" and (tb or b.isalnum() or b in "“("):
                cut = True
            elif ta and tb:
                cut = a not in "ๆฯ"
            elif a.isdigit() and (tb or b in "“("):
                m = re.search(r"(\S+)\s+\d+$", t[start:i])
                cut = bool(m and m.group(1).endswith(("ปี", "พ.ศ.", "ค.ศ.")))
            if cut:
                yield start, i
                start = j
            i = j
            continue
        i += 1
    if start < e:
        yield start, e


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    at = 0
    bounds = [m.span() for m in _empty.finditer(text)] + [(len(text), len(text))]
    for a, z in bounds:
        para, base = text[at:a], at
        at = z
        if not para.strip():
            continue
        pieces: list[tuple[int, int, bool]] = []
        # where list items begin
        starts, number, p = [], 0, 0
        for line in para.split("\n"):
            m = _item.match(line)
            if m:
                if m.group(1) is None:
                    starts.append(p)
                else:
                    v = int(m.group(1))
                    if p == 0 or v == 1 or v == number + 1:
                        starts.append(p)
                        number = v
            p += len(line) + 1
        if starts:
            if starts[0] > 0:
                pieces.append((0, starts[0], False))
            pieces += [(s, e, True) for s, e in zip(starts, starts[1:] + [len(para)])]
        else:
            pieces = [(0, len(para), False)]
        for s, e, item in pieces:
            part = para[s:e]
            if item:
                lead = len(part) - len(part.lstrip())
                body = part.strip()
                if body:
                    out.append((base + s + lead, base + s + lead + len(body)))
            else:
                for x, y in _prose(part, base + s):
                    if _thai.search(text, x, y):
                        out += _thai_parts(text, x, y)
                    else:
                        out.append((x, y))
    return out


def sentence_units(docs: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every unit.  One narrow pass; repeated rows become one by the list of places."""

    def rows(ids, texts):
        for i, t in zip(ids, texts):
            if i is not None and (u := units(t)):
                yield i, [{"start_pos": a, "end_pos": b} for a, b in u]

    found = map_arrow(docs.select("doc_id", "text"), rows, "doc_id long, u array<struct<start_pos:int,end_pos:int>>").distinct()
    return found.select("doc_id", F.explode("u").alias("u")).select("doc_id", "u.start_pos", "u.end_pos").distinct()
