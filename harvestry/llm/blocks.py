"""Two-pass block rules for Markdown pages: own content or the site's furniture.

A block is a line.  The first pass describes it by its length, stop-word density,
link density, sentence end and terms, and decides it where these speak clearly:
long blocks with many stop words and few links are content, blocks of links into
the site are furniture, and terms that stand in furniture add to either side.  The
second pass gives each ambiguous block the label of its nearest decided
neighbours, over runs of any length; headings take the label of what they head.

No furniture phrases are listed.  What terms and shapes weigh is learned by
`learn` from the pages themselves: blocks outside the stretch of long text, and
blocks that come back under several titles, are furniture, the others are not,
and the weights are the log-odds, refined in a few rounds.  Every page counts, whatever
its length: `learned` counts the lines of all pages where they are, and takes to the
driver only the counts of terms that occur twice.  Without pages to learn from,
`Rules()` has the weights of general web vocabulary and of shapes only.

A block's description depends on the line alone and is cached, because furniture
lines come back on every page of a site.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .messages import hit, notice
from .text import saved

# Words of web furniture in general use, by language; a prior that learned weights replace.
VOCABULARY = {
    "en": "recommended related popular about account advertisement archive careers comments contact cookie cookies copyright downloads facebook faq follow guest help home imprint instagram jobs linkedin login logout map members menu newsletter newsroom press privacy register reply reserved search share shop sign sitemap sponsored subscribe subscription terms twitter unsubscribe visitors youtube",
    "de": "abonnieren agb anmelden anzeige archiv barrierefreiheit cookies datenschutz facebook gast hilfe impressum karte kommentare kontakt konto menü newsletter nutzungsbedingungen presse rundbrief schlagwörter startseite suche teilen termine vorbehalten warenkorb",
    "fr": "abonnez accueil agenda aide archives boutique commentaires compte confidentialité connexion contact cookies facebook inscription lettre mentions newsletter partager plan presse publicité recherche réservés suivez",
    "es": "accesibilidad acerca agenda anuncio archivo aviso ayuda boletín buscar comentarios compartir contacto cookies cuenta entrar facebook inicio mapa menú prensa privacidad publicidad reservados suscríbete síguenos tienda",
    "ja": "検索 会社案内 ログイン 催し 写真 お問い合わせ ホーム 売店 ヘルプ メニュー 地図 採用 会員 広告 クッキー 利用規約 無断転載",
}

# Those of them that hardly stand in other text.
STRONG = "© cookie cookies copyright newsletter subscribe unsubscribe imprint impressum sitemap"

# Frequent function words.
STOP = frozenset(
    "the a an of to and in for on at by with is are was were be been has have had had it its this that these those from as or nor not no but than then which who what where when why how before after between until once without most only some our my your his her their there they we you he she if while every never nobody neither both had would could should will can do does did"
    " der die das ein eine einer eines einem einen und oder nicht kein keine ist sind war waren wird wurde wurden hat haben hatte im in am an auf aus bei mit nach seit von vor zu zum zur für über unter weil obwohl dass wenn als wie wer davon nur noch schon wieder eher selten laut zwischen ohne erst dann ende"
    " le la les un une des de du et ou ne pas plus est sont était fut a ont on il elle ils elles nous vous je que qui quoi dont où quand pour par sur sous dans au aux en avec sans ce cette ces son sa ses leur selon entre après avant depuis trop reste personne faut"
    " el los las lo una unos unas y o no es son era fue está están ha han se su sus por para con sin sobre entre según desde hasta cuando que quien cual donde como muy más ni ya sigue nadie tras había este esta estos estas".split()
)

LINK = re.compile(r"!?\[([^\]\[]*)\]\(([^()\s]*)\)")
BLANKS = re.compile(r"[ \t 　]+")
_marker = re.compile(r"(?:[*+•-]|\d{1,3}[.)])\s+")
_word = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_term = re.compile(r"[ぁ-ゖ゛-ヿ一-鿿]+|[^\W\d_ぁ-ゖ゛-ヿ一-鿿]+|\d+|[©·»>:：!！?？]")
_cjk = re.compile(r"[ぁ-ゖ゛-ヿ一-鿿]")
_kana = re.compile(r"[ぁ-ゖ]")
# The same terms where a text has one byte a character: what is not a letter, or not a figure, as blanks.
_byte = [bytes([i]).decode("cp1252", "replace") for i in range(256)]
_letters = bytes(i if re.match(r"[^\W\d_]", x) else 32 for i, x in enumerate(_byte))
_figure = bytes(i if re.match(r"\d", x) else 32 for i, x in enumerate(_byte))
# Names of a site's front page, by language.
HOME = {"home", "startseite", "accueil", "inicio", "ホーム", "トップ"}
_closers = "\"'”’»›」』)]*_"
_ends = frozenset(".!?…。！？:;")
_bullets = frozenset("*+•-")
_marks = frozenset("\\={}|<&$~")
_figures = re.compile(r"\|\s*[\d.,:%-]+\s*(?:\||$)")
_crumb = re.compile(r"(?:^|\s)[/»›>](?:\s|$)")

BLANK, BAD, GOOD, OPEN, FENCE, NOTICE, TITLE, HOMELINK, HEAD = range(9)
#: A block is long from so many words on, and has many stop words from such a share on.
LONG, DENSE = 20, 0.2
#: A score beyond this decides a block in the first pass.
SURE = 2.0
#: Rounds of refining weights, titles from which on a line comes back, and lines that a task holds at once.
ROUNDS, AGAIN, HELD = 3, 4, 50_000
# What shapes weigh where no pages were learned from: lengths (powers of 2), shares of stop words (eighths), ends, items, links.
_SHAPES = {
    "\x01n0": 0.0, "\x01n1": 1.2, "\x01n2": 0.7, "\x01n3": 0.0, "\x01n4": -1.0, "\x01n5": -2.4, "\x01n6": -2.8,
    "\x01s0": 0.6, "\x01s1": -0.2, "\x01s2": -0.6, "\x01s3": -0.7, "\x01s4": -0.7, "\x01e0": 0.5, "\x01e1": -0.8,
    "\x01i": 0.0, "\x01in": 1.5, "\x01out": -0.5,
}


def terms(low: str) -> list[str]:
    """Terms of a lower-case text: words, pairs of characters in scripts without blanks, one sign for all figures."""
    out = []
    for w in _term.findall(low):
        if w[0].isdigit():
            out.append("0")
        elif _cjk.match(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


def _narrow(low: str) -> list[str] | None:
    """Terms of a lower-case text in any order, repeated ones too, "0" for figures; null if a character is not one byte."""
    code = "ascii" if low.isascii() else "cp1252"
    try:
        raw = low.encode(code)
    except UnicodeEncodeError:
        return None
    out = raw.translate(_letters).decode(code).split()
    out += ["0"] * len(raw.translate(_figure).split())
    for x in ":!?>" if code == "ascii" else ":!?>©·»":
        if x in low:
            out += [x] * low.count(x)
    return out


_sizes, _shares = [f"\x01n{i}" for i in range(7)], [f"\x01s{i}" for i in range(5)]


class Block:
    """What the rules see of a line."""

    __slots__ = ("bullet", "crumbs", "dense", "end", "head", "image", "key", "kind", "linked", "local", "long", "marked", "names", "scored", "shapes", "terms", "words")

    def __init__(self, raw: str):
        # all whitespace but the blank is unprintable
        s = raw.strip(" ") if raw.isprintable() and "  " not in raw else " ".join(raw.split())
        self.key = low = s.lower()
        c = s[:1]
        self.head = 0
        if c == "#":
            level = len(low) - len(low.lstrip("#"))
            if level <= 6 and low[level : level + 1] == " ":
                self.head, low = level, low[level:].strip()
        first = low[:1]
        m = _marker.match(low) if first in _bullets or first.isdecimal() else None
        self.bullet = m is not None
        if m:
            low = low[m.end() :]
            first = low[:1]
        self.image = low.startswith("![")
        links = LINK.findall(low) if "](" in low else []
        text = LINK.sub(r"\1", low) if links else low
        found = _narrow(text)
        if found is None and _cjk.search(text):
            self.terms = frozenset(terms(text))
            cjk = len(_cjk.findall(text))
            self.words = words = max(len(_term.findall(text)), cjk // 2)
            stops = len(_kana.findall(text)) / 2
        else:
            if found is None:
                # of what a term may start with, only figures and the exclamation mark sort before the colon
                found = [w if w >= ":" or w == "!" else "0" for w in _term.findall(text)]
            self.terms = frozenset(found)
            self.words = words = len(found)
            stops = len([w for w in found if w in STOP])
        self.dense = dense = stops / max(1, words)
        #: share of the text that links have, and how many links lead into the site itself if no other does
        self.linked, self.local = 0.0, 0
        if links:
            self.linked = sum([len(a) for a, _ in links]) / max(1, len(text))
            local = [u for _, u in links if u.startswith("/") and not u.startswith("//") and "go?" not in u]
            self.local = len(local) if len(local) == len(links) and not self.image else 0
        self.end = end = text.rstrip(_closers)[-1:] in _ends and bool(text)
        self.marked = first in _marks or low.startswith("> ")
        self.names = not end and ("/" in text or ">" in text or "»" in text or "›" in text) and bool(_crumb.search(text))
        self.crumbs = self.names and _crumb.split(text)[0].strip() in HOME
        self.shapes = shapes = [_sizes[min(6, (words + 1).bit_length() - 1)], _shares[min(4, int(dense * 8))], "\x01e1" if end else "\x01e0"]
        if m:
            shapes.append("\x01i")
        if links:
            shapes.append("\x01in" if self.local else "\x01out")
        if self.names:
            shapes.append("\x01c")
        self.long, self.scored = False, None
        if s.startswith(("```", "~~~")):
            self.kind = FENCE
        elif self.head == 1:
            self.kind = TITLE
        elif self.head:
            self.kind = HEAD
        elif self.image or self.marked and not self.local or "|" in text and _figures.search(text):
            self.kind = GOOD
        elif len(links) == 1 and links[0][1] == "/" and self.linked > 0.9 and not m:
            self.kind = HOMELINK
        else:
            self.long = words >= LONG and dense >= DENSE and self.linked < 0.3
            self.kind = NOTICE if not self.long and notice(text) else OPEN


_blocks: dict[str, Block | None] = {}


def block(raw: str) -> Block | None:
    """The line's block; null if it is blank."""
    b = _blocks.get(raw, 0)
    if b == 0:
        b = Block(raw) if raw.strip(" \t\r\f\v  　") else None
        if len(raw) < 200:
            if len(_blocks) > 100_000:
                _blocks.clear()
            _blocks[raw] = b
    return b


def is_fence(line: str) -> bool:
    return line.lstrip().startswith(("```", "~~~"))


def is_notice(line: str) -> bool:
    b = block(line)
    return b is not None and (b.kind == NOTICE or b.head > 1 and notice(b.key))


def _uncoded(blocks: list[Block | None]) -> list[Block | None]:
    """The blocks without those of fenced code; a fence without an end goes to the end of the page."""
    if not any([b is not None and b.kind == FENCE for b in blocks]):
        return blocks
    out, code = [], False
    for b in blocks:
        fence = b is not None and b.kind == FENCE
        out.append(None if code or fence else b)
        code ^= fence
    return out


def general(words: bool = True) -> dict[str, float]:
    """Weights without any pages: shapes, and the words of VOCABULARY."""
    out = {t: 1.0 for v in VOCABULARY.values() for w in v.split() for t in terms(w)} if words else {}
    out |= dict.fromkeys(STRONG.split() if words else (), 3.0)
    return out | _SHAPES


Line = tuple[int, str, int, int, int, list[int]]


def _lines(pages: Iterable[tuple[str | None, str]]) -> Iterator[Line]:
    """(hash, features, kind, times within, times outside, titles) of the lines of pages (title, text); a line may come in parts.

    Within is the stretch from a page's first long block to its last; pages with under three are passed over.  kind is 1 for
    headings, 2 for long blocks; titles are hashes of up to AGAIN titles it stands under.
    """
    held: dict[str, list] = {}

    def parts() -> Iterator[Line]:
        for b, within, outside, titles in held.values():
            # headings of own text and of link lists look alike: only their terms tell
            features = " ".join(sorted(b.terms) if b.kind == HEAD else [*sorted(b.terms), *b.shapes])
            yield xxhash.xxh64_intdigest(b.key) - (1 << 63), features, 1 if b.kind == HEAD else 2 * b.long, within, outside, list(titles)
        held.clear()

    for title, text in pages:
        blocks = _uncoded([block(x) for x in text.split("\n")])
        at = [i for i, b in enumerate(blocks) if b is not None and b.long]
        if len(at) < 3:
            continue
        name = 0 if title is None else xxhash.xxh64_intdigest(title) - (1 << 63)
        for i, b in enumerate(blocks):
            if b is not None and b.kind in (OPEN, NOTICE, HEAD):
                x = held.get(b.key)
                if x is None:
                    x = held[b.key] = [b, 0, 0, (name,)]
                x[1 if at[0] <= i <= at[-1] else 2] += 1
                if len(x[3]) < AGAIN and name not in x[3]:
                    x[3] += (name,)
        if len(held) >= HELD:
            yield from parts()
    yield from parts()


Counted = tuple[list[str], bytes, bytes, bytes, bytes, bytes]
_counted = "vocabulary array<string>, ids binary, sizes binary, within binary, outside binary, kinds binary"


def _count(lines: Iterable[Line]) -> Iterator[Counted]:
    """Whole lines, their parts put together, as arrays: features as ids into a vocabulary, their number, times, kinds (4: it comes back)."""
    whole: dict[tuple[int, str], list] = {}
    for h, features, kind, within, outside, titles in lines:
        x = whole.get((h, features))
        if x is None:
            whole[h, features] = [kind, within, outside, set(titles)]
        else:
            x[1], x[2] = x[1] + within, x[2] + outside
            x[3].update(titles)
    every = list(whole.items())
    for k in range(0, len(every), HELD):
        some = every[k : k + HELD]
        split = pc.split_pattern(pa.array([f for (_, f), _ in some], pa.large_string()), " ")
        each = split.flatten()
        each = each.filter(pc.not_equal(each, "")).dictionary_encode()  # a line without features is split into an empty one
        at, ids = each.dictionary.to_pylist(), each.indices.to_numpy().astype(np.uint32)
        kinds = np.array([x[0] + 4 * (x[0] != 1 and len(x[3]) >= AGAIN) for _, x in some], np.uint8)
        sizes, within, outside = (np.array(v, np.uint32) for v in ([f.count(" ") + 1 if f else 0 for (_, f), _ in some], [x[1] for _, x in some], [x[2] for _, x in some]))
        yield at, (ids.astype(np.uint16) if len(at) < 1 << 16 else ids).tobytes(), sizes.tobytes(), within.tobytes(), outside.tobytes(), kinds.tobytes()


def _spoken(c: Counted, weights: dict[str, float] | None) -> Iterator[tuple[str | None, int, int]]:
    """(feature, times in furniture, times) by the weights of the round before; null: by structure alone.  The feature null has the sums.

    Furniture are, first, the blocks outside a page's stretch that are not long and those that come back; then those that weights,
    their place and their coming back speak for.  Weights are whole thousandths, so that the order of sums is of no matter.
    """
    names, ids, sizes, within, outside, kinds = c
    ids = np.frombuffer(ids, np.uint16 if len(names) < 1 << 16 else np.uint32)
    sizes, within, outside, kinds = np.frombuffer(sizes, np.uint32), np.frombuffer(within, np.uint32), np.frombuffer(outside, np.uint32), np.frombuffer(kinds, np.uint8)
    lines = np.repeat(np.arange(len(sizes)), sizes)
    again, long = kinds >= 4, kinds & 2 > 0
    if weights is None:
        inner, outer = again, again | ~long
    else:
        w = np.rint(np.array([weights.get(t, 0.0) for t in names]) * 1000)
        s = np.bincount(lines, w[ids], len(sizes)) + 3000 * again - 4000 * long
        inner, outer = s > 1000, s > -1000
    bad = np.bincount(ids, (within * inner + outside * outer).astype(float)[lines], len(names))
    every = np.bincount(ids, (within.astype(float) + outside)[lines], len(names))
    return zip([None, *names], [int(bad.sum()), *bad.astype(np.int64).tolist()], [int(every.sum()), *every.astype(np.int64).tolist()])


def _weights(counts: dict[str | None, tuple[int, int]], start: dict[str, float]) -> dict[str, float]:
    """Log-odds of furniture, drawn towards `start` where counts are small; what occurs once has none but counts in the sums."""
    total_bad, total = counts.get(None, (0, 0))
    total_bad, total_good = total_bad + 500, total - total_bad + 500
    weights = dict(start)
    for t, (bad, n) in counts.items():
        if t is not None and (n > 1 or t in start):
            w = math.log((bad + 0.5) / total_bad) - math.log((n - bad + 0.5) / total_good)
            weights[t] = round((n * max(-3.0, min(3.0, w)) + 3 * start.get(t, 0.0)) / (n + 3), 3)
    return weights


def learn(pages: Iterable[tuple[str | None, str]], rounds: int = ROUNDS, start: dict[str, float] | None = None) -> Rules:
    """Rules with the weights that the pages (title, markdown) speak for, in this process."""
    start = general() if start is None else start
    parts, weights = list(_count(_lines(pages))), None
    for _ in range(rounds + 1):
        by: dict[str | None, list[int]] = {}
        for c in parts:
            for t, bad, n in _spoken(c, weights):
                x = by.setdefault(t, [0, 0])
                x[0], x[1] = x[0] + bad, x[1] + n
        weights = _weights(by, start)
    return Rules(weights)


def learned(pages: DataFrame, key: str = "page_id", title: str = "title", text: str = "markdown_ir", form: Callable[[str], str] | None = None) -> Rules:
    """Rules that `learn` would make of all pages, whatever their length, counted where the pages are; `form` turns texts to Markdown.

    Repeated rows count once; where there is no column of the name `title`, the key stands for it.  One shuffle brings repeated rows
    together, another the parts of a line; what the driver gets is the counts of features that occur twice, once a round.
    """
    name = F.col(title if title in pages.columns else key).cast("string")
    src = pages.select(F.col(key).alias("k"), name.alias("title"), F.col(text).alias("text")).where("k is not null and text <> ''")
    src = src.select(F.xxhash64("k", "title", "text").alias("h"), "title", "text").repartition("h")

    def lines(batches):
        seen: set[int] = set()

        def texts():
            for b in batches:
                for h, title, text in zip(*(c.to_pylist() for c in b.columns)):
                    if h not in seen:
                        seen.add(h)
                        yield title, text if form is None else form(text)

        return _lines(texts())

    parts = streamed(src, lines, "h long, features string, kind int, within long, outside long, titles array<long>", 5000)
    parts = parts.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")  # a task holds its lines
    counted = saved(streamed(parts, lambda batches: _count(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), _counted, 1))
    start, weights = general(), None
    for _ in range(ROUNDS + 1):

        def spoken(batches, weights=weights):
            for b in batches:
                for c in zip(*(c.to_pylist() for c in b.columns)):
                    yield from _spoken(c, weights)

        by = streamed(counted, spoken, "t string, bad long, n long", 20_000).groupBy("t").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        rows = by.where((F.col("n") > 1) | F.col("t").isNull() | F.col("t").isin(list(start))).toArrow()
        t, bad, n = (rows.column(i).to_pylist() for i in range(3))
        weights = _weights(dict(zip(t, zip(bad, n))), start)
    return Rules(weights)


def streamed(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str, size: int) -> DataFrame:
    """The rows fn makes of a task's batches, in batches of `size`.

    Meanwhile the collector of cycles rests: millions of small objects would be looked through again and again, and none are in cycles.
    """
    import gc
    from itertools import batched

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        gc.disable()
        try:
            for rows in batched(fn(batches), size):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
        finally:
            gc.enable()

    return df.mapInArrow(run, schema)


class Rules:
    """Weights of terms and shapes; what has none weighs nothing."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = general() if weights is None else weights

    def score(self, b: Block) -> tuple[float, float]:
        """What the block's terms, and its shape, weigh; over 0 speaks for furniture."""
        s = b.scored
        if s is None or s[0] is not self.weights:
            get = self.weights.get
            s = b.scored = (self.weights, sum(map(get, b.terms, repeat(0.0))), sum(map(get, b.shapes, repeat(0.0))))
        return s[1], s[2]

    def tells(self, raw: str) -> bool:
        """Whether a line is long content, whatever stands around it."""
        b = block(raw)
        return b is not None and b.long and sum(self.score(b)) < -SURE

    def first(self, b: Block, anchored: bool) -> int:
        """First pass: 1 furniture, 2 content, 3 a notice, 0 ambiguous."""
        if b.kind in (TITLE, GOOD, HOMELINK):
            return 2
        if b.kind == NOTICE:
            return 3
        if b.kind == HEAD:
            return 0
        if b.local >= 3 and b.linked > 0.7 or b.crumbs or "©" in b.terms and b.words < LONG:
            return 1
        t, s = self.score(b)
        if anchored:
            return 1 if t + s > SURE else 2 if t + s < -SURE else 0
        # Where no long text tells what a page is about, shapes say little: links and short lines may be all it has.
        share = t / max(1, len(b.terms) - ("0" in b.terms))
        if t > SURE and share > 0.6 or b.words <= 3 and share > 0.8 and t + s > SURE and b.shapes[-1] != "\x01out":
            return 1
        return 2 if b.long else 0

    @staticmethod
    def _level(label: list[int], plain: list[Block | None]) -> None:
        """Lines of one shape in a row are of one kind: a list is furniture if most of its entries are."""
        n, i = len(plain), 0
        kind = [None if b is None or b.kind != OPEN else (b.bullet, b.local > 0, b.linked > 0.5) for b in plain]
        while i < n:
            j = i + 1
            while j < n and kind[j] == kind[i]:
                j += 1
            if j - i >= 3 and kind[i] and any(kind[i]):
                most = 2 * sum(x == 1 for x in label[i:j]) > j - i
                label[i:j] = [1 if most else 0 if x == 1 else x for x in label[i:j]]
            i = j

    def furniture(self, lines: list[str]) -> list[bool]:
        """For each line, whether it is furniture; blank lines and code are not."""
        blocks = [block(x) for x in lines]
        blocks_ = _uncoded(blocks)
        at = [i for i, b in enumerate(blocks) if b is not None]
        plain = [blocks_[i] for i in at]  # null: code
        n = len(at)
        anchored = any(b is not None and b.long and sum(self.score(b)) < SURE for b in plain)
        label = [2 if b is None else self.first(b, anchored) for b in plain]
        for i in range(1, n - 1):
            # a link or label of no known terms right between own blocks is the name of an entry
            if label[i] == 1 and label[i - 1] == label[i + 1] == 2 and plain[i].kind == OPEN and self.score(plain[i])[0] < 1:
                label[i] = 0
        if not anchored:
            self._level(label, plain)
            # what reads like an error, filler or a notice is what such a page shows
            label = [2 if x == 2 or b.kind in (OPEN, HEAD) and hit(b.key) else x for x, b in zip(label, plain)]
        for i in range(n):
            # what a heading of furniture heads in links and labels is furniture
            if plain[i] is not None and plain[i].kind == HEAD and self.score(plain[i])[0] >= 1:
                j = i + 1
                while j < n and plain[j] is not None and label[j] != 1 and (plain[j].local == 1 or plain[j].bullet and not plain[j].end):
                    j += 1
                if sum(b.local == 1 for b in plain[i + 1 : j]) >= 1 or self.score(plain[i])[0] > SURE:
                    label[i + 1 : j] = [1] * (j - i - 1)
        if not anchored:
            # short sentences are a page's text if most of what is not furniture is in them
            said = [b is not None and not x and b.kind == OPEN and b.end and b.words >= 8 and b.dense >= DENSE for x, b in zip(label, plain)]
            rest = sum(b.words for b, x, y in zip(plain, label, said) if b is not None and b.kind == OPEN and not x and not y)
            if any(said) and sum(b.words for b, y in zip(plain, said) if y) >= rest:
                label = [2 if y else x for x, y in zip(label, said)]
        own = any(x == 2 and (b is None or b.kind not in (TITLE, HOMELINK)) for x, b in zip(label, plain))
        # Notices are furniture beside other text; where there is none, they are what the page shows.
        label = [(1 if own else 2) if x == 3 else x for x in label]
        own = own or any(x == 2 and b is not None and b.kind == NOTICE for x, b in zip(label, plain))
        head = [b is not None and b.kind == HEAD for b in plain]
        # Second pass.  Headings stand for content here; beyond the page's ends there is furniture.
        before, after = [(1, -1)] * n, [(1, n)] * n
        held = (1, -1)
        for i in range(n):
            before[i] = held
            if label[i] or head[i]:
                held = (label[i] or 2, i)
        held = (1, n)
        for i in range(n - 1, -1, -1):
            after[i] = held
            if label[i] or head[i]:
                held = (label[i] or 2, i)
        out = list(label)
        i = 0
        while i < n:
            if label[i] or head[i]:
                i += 1
                continue
            j = i
            while j < n and not label[j] and not head[j]:
                j += 1
            k = i
            while k < j:
                # blocks of one shape in a row are one list and stay together
                e = k + 1
                while e < j and _shape(plain[e]) == _shape(plain[k]):
                    e += 1
                (x, p), (y, q) = before[k], after[k]
                if not own:
                    # The page has nothing else: an ambiguous block is its own, unless it is a label between furniture.
                    mine = not (x == y == 1 and j - i <= 2 and plain[k].words <= 3 and plain[k].local and label[i - 1 : i] == [1])
                    out[k:e] = [2 if mine else 1] * (e - k)
                elif x == y:
                    out[k:e] = [x] * (e - k)
                else:
                    near = k - p - (q - e + 1)
                    for m in range(k, e):
                        out[m] = x if near < 0 else y if near > 0 else 1 if sum(self.score(plain[m])) > 0 else 2
                k = e
            i = j
        for i in range(n - 1, -1, -1):
            if head[i]:
                # A heading is furniture if it heads nothing but links and labels that are.
                j = i + 1
                linked = 0
                while j < n and not head[j] and out[j] == 1:
                    linked += plain[j].local > 0 or plain[j].bullet
                    j += 1
                first = plain[i + 1] if i + 1 < n else None
                links = linked and (first.local or first.bullet)
                out[i] = 1 if links or j > i + 1 and (j == n or head[j]) and self.score(plain[i])[0] > SURE else 2
        bad = [False] * len(lines)
        for i, x in zip(at, out):
            bad[i] = x == 1
        return bad

    def body_lines(self, markdown: str | None) -> list[str]:
        """The lines that are the page's own content."""
        lines = (markdown or "").split("\n")
        return [x for x, bad in zip(lines, self.furniture(lines)) if not bad]


def _shape(b: Block) -> tuple[bool, bool, bool]:
    """Labels of up to three words are of one shape, linked into the site or not, in a list or not."""
    if b.words <= 3 and not b.end and (b.local or b.linked == 0):
        return True, True, False
    return b.bullet, b.local > 0, b.linked > 0.5


GENERAL = Rules()


def furniture(lines: list[str]) -> list[bool]:
    """By general weights only."""
    return GENERAL.furniture(lines)
