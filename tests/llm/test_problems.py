"""Operators of the problems: examples, brute force, and odd tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.llm import blocks, furniture, markup, mixing, neardup, packing, queries, repeated, residue, seen, sentences, sql, stuffing, tokens

PAGE = "page_id long, url string, root_hostname string, title string, markdown_ir string, lang string, fetched_at timestamp, loaded_at timestamp, line_no string, k string, site string, first string"
#: What a page table may hold beside plain pages: nulls anywhere, empty and very long texts, repeated rows, columns named like ours.
ODD = [
    (1, "https://a.test/x", None, "t", "# T\nA fine page on the way to the town of the river.\n", "en"),
    (1, "https://a.test/x", None, "t", "# T\nA fine page on the way to the town of the river.\n", "en"),
    (2, None, None, None, None, None),
    (3, "", "", "", "", ""),
    (4, "no address", None, None, "\n\n\n", None),
    (None, "https://a.test/y", None, "{{title}}", "{{body}}", None),
    (5, "https://a.test/z", None, None, "word " * 60_000, None),
    (6, "https://a.test/z", None, None, "```\nunclosed {{x}} <b>\n", None),
    (7, "https://a.test/\x00", None, "\x00", "\x00 \ud7ff 😀\t\u2028", None),
]


def odd(spark):
    return spark.createDataFrame([(*r, None, None, "1", "2", "3", "4") for r in ODD], PAGE)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_queries_run_and_sql_agrees(spark, data):
    from oracle import compare

    for name, q in queries.queries().items():
        assert q(spark, data).count() > 0, name
    for name, text in sql.SQL.items():
        compare(spark, data, queries.queries()[name], text)


@pytest.mark.parametrize("op", [residue.template_residue, stuffing.keyword_pages, repeated.repeated_lines, repeated.without_repeated, furniture.furniture_lines, furniture.main_bodies, markup.markup_kinds, markup.clean_pages])
def test_odd_pages(spark, op):
    rows = op(odd(spark)).collect()
    assert None not in [r[0] for r in rows]
    assert op(odd(spark).limit(0)).count() == 0


def test_odd_page_results(spark):
    df = odd(spark)
    assert ids(residue.template_residue(df)) == []
    assert ids(stuffing.keyword_pages(df)) in ([], [5])
    assert Counter(r.page_id for r in furniture.main_bodies(df).collect()) == Counter([1, 2, 3, 4, 5, 6, 7])
    assert ids(markup.markup_kinds(df)) == []


# 1
@pytest.mark.parametrize(
    "title,body,case",
    [
        ("{{title}} | X", "Some text of the page that is long enough to be read.", True),
        ("X", "Dear {first_name}, the order of the day is on its way.", True),
        ("X", "We met [INSERT NAME HERE] and %(city)s and @@BODY@@ on the way.", True),
        ("X", "In code a name is written `{{ name }}` and that is all there is to it.", False),
        ("X", "```\n{{ a }} ${b}\n```\nThe rest of the page tells how templates are filled.", False),
        ("X", r"The \emph{word} and \frac{2}{n_7} of the sum were of no use to anyone.", False),
        ("404", "# 404\nThe requested URL /x was not found on this server.", True),
        ("X", "Lorem ipsum dolor sit amet.\n\nDolor sit elit magna.", True),
        ("X", "Please enable JavaScript to view this page.", True),
        ("X", 'The words "page not found" met most of the visitors who came to the town by train in the spring of the year, and nobody knew why.\n\nThe clerk of the town wrote them down in the book of the year, with the day and the hour and the name of the visitor.', False),
        ("Untitled Page", "The clerk of the town wrote the names down in the book.", False),
        ("Loading...", "", False),
    ],
)
def test_residue(title, body, case):
    assert residue.by_itself(blocks.GENERAL, "https://a.test/x", title, body) == case


def test_shared_doubtful_body(spark):
    text = "Try again in a while, the page is not available\nplease wait for the clerk of it"
    df = spark.createDataFrame([(i, f"https://a.test/{i}", "Clerk", text) for i in range(3)] + [(9, "https://a.test/9", "Clerk", text.replace("clerk", "cook"))], "page_id long, url string, title string, markdown_ir string")
    assert not any(residue.by_itself(blocks.GENERAL, f"https://a.test/{i}", "Clerk", text) for i in range(3))
    found = ids(residue.template_residue(df))
    assert found in ([0, 1, 2], [0, 1, 2, 9], [])


# 2
def test_host_evidence(spark):
    """A short body of no listed wording is a case under many addresses it does not answer to, on one host or several."""
    odd = "The hamsters are on strike today."
    one = [(i, f"https://a.test/{w}", w.title(), odd) for i, w in enumerate(["ferries", "harbour", "weather", "archive-list", "lantern"])]
    many = [(10 + i, f"https://{h}.test/{w}", w.title(), "Nobody is minding the shop.") for i, (h, w) in enumerate(zip("bcd", ["bridges", "markets", "gardens"]))]
    mirror = [(20 + i, f"https://m{i}.test/tunnels", "Tunnels", "Short but real text.") for i in range(8)]
    answers = [(30 + i, f"https://e.test/{w}", w.title(), "All about ferries, harbour, weather, lantern and gardens.") for i, w in enumerate(["ferries", "harbour", "weather", "lantern", "gardens"])]
    few = [(40 + i, f"https://f.test/{w}", w.title(), "Rarely seen twice.") for i, w in enumerate(["ferries", "harbour"])]
    df = spark.createDataFrame(one + many + mirror + answers + few, "page_id long, url string, title string, markdown_ir string")
    assert ids(residue.template_residue(df)) == [0, 1, 2, 3, 4, 10, 11, 12]
    got = {r.page_id: (r.reason, r.same_line_pages, r.same_line_hosts) for r in residue.evidence(df).collect() if r.residue}
    assert got == {i: ("message", 5, 1) for i in range(5)} | {i: ("message", 3, 3) for i in (10, 11, 12)}


def test_long_error():
    trace = "Fatal error: Uncaught RuntimeException: database connection failed while loading the page.\n" + "\n".join(f"#{i} /var/www/site/lib/loader/module_{i}.php({i}7): Loader->open()" for i in range(9))
    for times in (1, 12):
        assert residue.by_itself(blocks.GENERAL, "https://a.test/harbour", "Harbour", "\n".join([trace] * times))
    story = "The keeper saw the words page not found on the board and walked on along the quay to the house. Then it rained for days and the ferry stayed where it was, and nobody came to look for it. " * 3
    assert not residue.by_itself(blocks.GENERAL, "https://a.test/harbour", "Harbour", story)


@pytest.mark.parametrize("body", ["410 Gone", "HTTP Status 404", "Web server is down", "Oops! That page can't be found.", "This account has been disabled.", "Pagina non trovata", "503 Service Unavailable\nnginx/1.18.0"])
def test_messages_of_other_wordings(body):
    assert residue.by_itself(blocks.GENERAL, "https://a.test/harbour-lights", "Harbour lights", body)


def test_residue_needs_more_than_terms():
    """Error terms on a page that answers to its title are no case; the comparison decides."""
    page = ("https://a.test/harbour-lights", "Gateway guide for beginners", "Bad gateway: a guide for beginners")
    assert not residue.by_itself(blocks.GENERAL, *page)
    assert residue.by_itself(blocks.GENERAL, page[0], "Harbour lights", "502 Bad gateway")


def test_stuffing():
    assert stuffing.stuffed(blocks.GENERAL, "u", "t", "# x\n" + "cheap boots / buy boots / boots sale / lamp deals / review lamp / " * 8)
    assert stuffing.stuffed(blocks.GENERAL, "u", "t", "\n".join(f"* bicycle Model{i}" for i in range(20)))
    assert stuffing.stuffed(blocks.GENERAL, "u", "t", "\n".join(f"[cheap boots {i}](https://x.test/{i})" for i in range(20)))
    assert not stuffing.stuffed(blocks.GENERAL, "u", "t", "\n".join(f"[Name{i}](/name-{i})\nThe mill of the town was sold to the clerk in the year {i}.\n" for i in range(9)))
    assert not stuffing.stuffed(blocks.GENERAL, "u", "t", "The clerk of the town wrote it down. Nobody in the mill had read it before the end of the year.")
    regular, back, top, distinct = stuffing.recurrence(["a", "b"] * 40)
    assert regular and back > 0.9 and top > 0.9 and distinct < 0.1
    assert stuffing.recurrence([])[1:] == (0.0, 0.0, 1.0)


def test_stuffed_sentences(monkeypatch):
    """Sentences whose terms come back at regular places are not real; irregular recurrence rejects a page."""
    spam = " ".join(f"If you want the best cheap boots in {t}, then buy the cheap boots of our shop in {t}." for t in ("Ulm", "Bonn", "Hof", "Kiel", "Jena", "Suhl"))
    story = "The keeper of the lamp walked down to the pier. A boat had left before the rain, and nobody knew where it was. In the end the clerk of the town wrote to the harbour office. They had never seen the boat."
    assert stuffing.stuffed(blocks.GENERAL, "u", "t", spam)
    assert not stuffing.stuffed(blocks.GENERAL, "u", "t", story)
    old = stuffing.recurrence
    monkeypatch.setattr(stuffing, "recurrence", lambda t: ([], 0.0, 0.0, old(t)[3]))
    assert not stuffing.stuffed(blocks.GENERAL, "u", "t", spam)


@pytest.mark.parametrize("size", [20, 30, 150])
def test_stuffing_of_a_long_list(size):
    """More repetition does not hide a list: any number of distinct terms, over and over on one line."""
    once = " ".join(f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(size))
    for times in (2, 3, 12):
        assert stuffing.stuffed(blocks.GENERAL, "u", "t", "# x\n" + " ".join([once] * times))


# 3
@pytest.mark.parametrize("n,span", [(1, 10), (3, 10), (200, 60000), (5000, 65536), (5000, 5000), (40000, 65536)])
def test_bitmap_round_trip(n, span):
    v = np.sort(np.random.default_rng(n).choice(span, n, replace=False)).astype(np.uint16)
    assert (repeated.decode(repeated.encode(v)) == v).all()
    assert len(repeated.encode(v)) <= 8193
    half = [repeated.encode(v[::2]), repeated.encode(v[1::2] if n > 1 else v)]
    assert (repeated.decode(repeated.union(half)) == v).all()


def test_repeated_against_scan(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        site = rng.choice(["a.test", "b.test", "b.test", "b.test"])
        lines = [rng.choice(["Share  this", "share this", "Legal\tnotice", "SHARE THIS ", f"own {i}", "rare %d" % rng.randrange(60)]) for _ in range(4)]
        rows.append((i * 3000, rng.choice(["https://", "http://www."]) + site.upper() + rng.choice(["", ":8080"]) + f"/{i}", "\n".join(lines)))
    rows += rows[:40]
    on, size = defaultdict(set), defaultdict(set)
    for i, u, t in rows:
        s = "a.test" if "A.TEST" in u else "b.test"
        size[s].add(i)
        for x in t.split("\n"):
            on[s, " ".join(x.split()).lower()].add(i)
    want = {k for k, v in on.items() if len(v) >= 5 and len(v) * 10 >= len(size[k[0]])}
    df = spark.createDataFrame(rows, "page_id long, url string, markdown_ir string")
    got = repeated.repeated_lines(df).collect()
    assert {(r.site, r.line) for r in got} == want and len(got) == len(want)
    assert all(r.documents == len(on[r.site, r.line]) for r in got)
    lines = {k for k in want}
    for r in repeated.without_repeated(df).collect():
        site = "a.test" if "A.TEST" in next(u for i, u, _ in rows if i == r.page_id) else "b.test"
        text = next(t for i, _, t in rows if i == r.page_id)
        assert r.cleaned == "\n".join(x for x in text.split("\n") if (site, " ".join(x.split()).lower()) not in lines)


# 4
@pytest.fixture(scope="module")
def rules(spark):
    """Rules learned from the pages of 0.01."""
    from pathlib import Path

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("no test data")
    return blocks.learned(spark.read.parquet("/root/testdata/sf0.01/page_ir.parquet"))


def test_furniture(rules):
    page = "\n".join(
        ["* Search", "* About us", "Home > News > A day", "", "# A day on the river", "Written by Ann Lee", "The boat left the pier at dawn and came back late.", "", "Tell a friend about this page", "", "| a | 1 |", "", "## Related pages",
         "[The mill and the town](/mill-12)", "* Notes on the pier no. 3", "12 comments", "We use cookies to measure visits. Accept all", "© 2020 River Media. All rights reserved.", "[Search](/0)"]
    )
    bad = [i for i, b in enumerate(rules.furniture(page.split("\n")), 1) if b]
    assert bad == [1, 2, 3, 6, 9, 13, 14, 15, 16, 17, 18, 19]
    assert blocks.furniture([]) == [] and blocks.furniture([""]) == [False]
    html = "<nav><a href='/a'>Search</a></nav><h1>Day</h1><p>The boat left the pier at dawn.</p><footer><p>© 2020 River Media. All rights reserved.</p></footer>"
    lines = furniture.blocks_of_html(html)
    assert [x for x, b in zip(lines, blocks.furniture(lines)) if not b] == ["# Day", "The boat left the pier at dawn."]


def test_furniture_of_links():
    """Menus of unknown labels, long related lists and long lines of links are furniture; a page's own list of links is not."""
    text = ["The boat left the pier at dawn and came back late.", "The crew went home on foot, since no bus was there."]
    menu = ["[Quayside](/quay)", "* [Pilots](/pilots)", "[Tidebook](/tide)", "[Moorings](/moor)"]
    plain = ["Quayside", "Pilots", "Tidebook", "Moorings"]
    related = ["## Related pages", *(f"[The mill of the town](/mill-{i})" for i in range(12))]
    wide = " | ".join(f"[Harbour label {i}](/harbour/label/{i})" for i in range(20))
    for more in (menu, plain):
        lines = ["* Search", *more, "* About us", *text, *related, "12 comments", wide, "[Alpha](/a) | [Beta](/b) | [Gamma](/c)"]
        assert [x for x, b in zip(lines, blocks.furniture(lines)) if not b] == text
    for mine in (plain, menu, ["[cheap boots](/go?id=1)", "[boots](https://x.test/1)", "* #boots"]):
        lines = ["* Search", *mine, "12 comments"]
        assert [x for x, b in zip(lines, blocks.furniture(lines)) if not b] == mine


def _sites(spark):
    """Pages of two sites with furniture in invented words, beside what is their own."""
    rng = random.Random(2)
    noun = ["harbour", "lantern", "orchard", "quarry", "library", "workshop", "garden", "ferry"]
    rows, want = [], {}
    for i in range(120):
        text = [f"The keeper of the {rng.choice(noun)} {rng.choice(noun)} had been told that the {rng.choice(noun)} of the town would not be open until the end of the year {i}, and nobody at the {rng.choice(noun)} knew why it was so." for _ in range(4)]
        lines = ["Zorbl Quandle", "[Frimble](/f)", f"# The {rng.choice(noun)} {i}", text[0], text[1], "Wibble your chums, quick!", text[2], text[3], "Blorptastic notes by Vim", f"Gronk counted {i} flips"]
        rows.append((i, f"https://{'ab'[i % 2]}.test/{i}", f"Title {i}", "\n".join(lines)))
        want[i] = [1, 2, 6, 9, 10]
    return spark.createDataFrame(rows, "page_id long, url string, title string, markdown_ir string"), want


def test_furniture_learned_without_lists(spark, monkeypatch):
    """Furniture in words no list has is found by what the pages teach, with the vocabulary emptied."""
    df, want = _sites(spark)
    monkeypatch.setattr(blocks, "VOCABULARY", {})
    got = defaultdict(list)
    for r in furniture.furniture_lines(df).collect():
        got[r.page_id].append(r.line_no)
    assert {i: sorted(v) for i, v in got.items()} == want


def test_all_pages_teach(spark, monkeypatch):
    """Weights are those of all pages, more than any sample had, long ones too; repeated rows and the cut into tasks change nothing."""
    long = "The keeper of the {} had been told that the gate of the town would not be open until the end of the year and nobody knew why it was so."
    own = lambda n: "x" + "".join(chr(97 + int(c)) for c in str(n))
    rows = [(i, f"Title {i % 7}", "\n".join([f"Zorbl q{own(i)}", f"# Name {i}", *(long.format(f"w{own(i % 900)} {k}") for k in range(3)), f"Wibble c{own(i % 40)}"])) for i in range(4300)]
    rows += [(9000 + i, None, "\n".join(["Snorfle twice", *[long.format(f"big {k}") for k in range(300)], "Blump"])) for i in range(2)]
    want = blocks.learn([r[1:] for r in rows]).weights
    assert "q" + own(2999) not in want and {"snorfle", "blump", "w" + own(0), "c" + own(3)} <= want.keys()
    monkeypatch.setattr(blocks, "HELD", 70)
    assert blocks.learn([r[1:] for r in rows]).weights == want
    schema = "page_id long, title string, markdown_ir string"
    df = spark.createDataFrame([*rows, *rows[:500], (None, "a", rows[0][2]), (5, "a", None), (6, "a", "")], schema)
    assert blocks.learned(df).weights == want
    assert blocks.learned(df.repartition(7)).weights == want
    assert blocks.learned(df.limit(0)).weights == blocks.general()


def test_terms_of_one_byte_texts(monkeypatch):
    """Terms of lines of one byte a character are taken without the pattern for all scripts, and are the same; so are those of other lines."""
    rng = random.Random(4)
    latin = "The boat a1b22 left: 3 piers! At the “Café” — œuvre n° 12, ÿ½² d'été? © 2020 » Menü · the end > ñ_ß µª"
    other = latin + "ā٣३ж漢字かなー：！？İſ²\u0301\u200b\x81"
    used = []

    class Counted:
        findall = staticmethod(lambda text, find=blocks._term.findall: used.append(text) or find(text))

    for chars, n in ((latin, 0), (other, 1)):
        lines = ["".join(rng.choices(chars, k=rng.randint(1, 60))) for _ in range(2000)] + [chars]
        low = [" ".join(x.split()).lower() for x in lines]
        want = [blocks.terms(x) if blocks._cjk.search(x) else ["0" if w[0] in "0123456789" else w for w in blocks._term.findall(x)] for x in low]
        with monkeypatch.context() as m:
            m.setattr(blocks, "_term", Counted)
            got = [blocks.Block("x " + x) for x in lines]  # no marker at the start
        assert (len(used) > 0) == n
        for x, b, w in zip(low, got, want):
            assert b.terms == {"x", *w}, x
            if not blocks._cjk.search(x):
                assert b.words == 1 + len(w) and b.dense == sum(t in blocks.STOP for t in w) / b.words, x


def test_second_pass_decides(spark, data):
    """Without the second pass ambiguous blocks would stay: it labels blocks of both kinds, in runs of any length."""
    pages = [(r.title, r.markdown_ir) for r in spark.read.parquet(f"{data}/page_ir.parquet").collect() if r.markdown_ir]
    rules = blocks.learn(pages)
    by = Counter()
    for _, text in pages:
        lines = text.split("\n")
        plain = blocks._uncoded([blocks.block(x) for x in lines])
        anchored = any(b is not None and b.long for b in plain)
        for b, bad in zip(plain, rules.furniture(lines)):
            if b is not None and rules.first(b, anchored) == 0:
                by[bad] += 1
    assert by[True] > 20 and by[False] > 20


@pytest.mark.parametrize("line", ["Subscribe to our newsletter", "Follow us on Facebook", "Privacy Policy | Terms of Service | Contact", "This website uses cookies to ensure you get the best experience on our website."])
def test_furniture_of_other_wordings(line):
    """Common furniture in words of general use, around and within own text, without any page to learn from."""
    text = "The keeper of the lamp had been told that the harbour of the town would not be open until the end of the year, and nobody at the pier knew why it was so. It was the first time in the life of the town that a boat had to wait for more than a day."
    lines = [line, "# The lamp", text, text, line, "Home | About us | Sign in"]
    assert blocks.furniture(lines)[0] and blocks.furniture(lines)[4] and not any(blocks.furniture(lines)[1:4])


def test_undecided_runs_inherit():
    """A run of any number of ambiguous blocks takes the label of what is nearest."""
    text = "The keeper of the lamp had been told that the harbour of the town would not be open until the end of the year, and nobody at the pier knew why it was so."
    for n in (1, 3, 9):
        own = [f"Grommet part {chr(97 + i)} of oak" for i in range(n)]
        lines = ["# Parts", text, *own, text, "Contact | Imprint | Privacy"]
        assert blocks.furniture(lines) == [False] * (n + 3) + [True]


# 5
@pytest.mark.parametrize(
    "text,kinds",
    [
        ("a <b>bold</b> word", ["html"]),
        ("a&nbsp;b &amp;amp; c", ["html"]),
        ("&lt;i&gt;x&lt;/i&gt;", ["html"]),
        ("2 < 5 > 1, a <b and AT&T", []),
        ("see [[File:x.jpg|thumb|Cap]] and '''this'''", ["wiki"]),
        ("== Head ==\n{| class=x\n|-\n| a || b\n|}", ["wiki"]),
        ("14'' x 18'' and == 5", []),
        (r"\section{A} and \emph{b} $x_1^2$", ["latex"]),
        (r"costs $5 in summer and $8 in winter, C:\new\text.txt", []),
        ("`<b>` and\n```\n[[x]]\n```", []),
        ("{{ name }} and **bold** [a](b)", []),
        ("${product} was $8 and ${city} was $", []),
        (r"<b>x</b> [[y]] \textbf{z}", ["html", "wiki", "latex"]),
        (None, []),
        ("", []),
    ],
)
def test_markup_kinds(text, kinds):
    assert markup.kinds(text) == kinds


def test_markup_clean():
    text = "== Head ==\n* a <b>bold</b>&nbsp;word\n{| class=x\n|-\n| a || b\n|}\n```\n<b>[[x]]</b>\n```\n\\section{S}\n\\begin{itemize}\n\\item one \\emph{two}\n\\end{itemize}\nsum $\\frac{1}{2}$ see [[P|there]]"
    assert markup.clean(text) == "## Head\n* a bold\xa0word\n| a | b |\n```\n<b>[[x]]</b>\n```\n## S\n* one two\nsum $\\frac{1}{2}$ see there"
    assert markup.clean_html("<h2>A</h2><p>x <code>a<b</code></p><pre>y\n z</pre>") .startswith("## A")
    assert markup.clean_html("no markup") == "no markup" and markup.clean_html(None) == ""


def test_common_lines():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [[rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        assert len(markup.common(a, b)) == t[0][0]


def test_common_lines_of_long_pages():
    """Lines that come back on long pages are aligned like those of short ones."""
    a = [f"line {i % 50}" for i in range(2500)]
    b = ["first", *a[:1200], "between", *a[1200:], "last"]
    c = ["start", *a, "end"]
    assert markup.common(c, b) == set(range(1, 2501))
    rng = random.Random(5)
    x, y = [[rng.choice("abcdefgh") for _ in range(2200)] for _ in range(2)]
    t = [0] * (len(y) + 1)
    for v in x:
        left = 0
        for j, w in enumerate(y):
            left, t[j + 1] = t[j + 1], left + 1 if v == w else max(t[j], t[j + 1])
    assert len(markup.common(x, y)) == t[-1]


def test_differencing(spark):
    top, foot = "Menu of the site", "Legal note of the site"
    rows = [(i, f"https://a.test/n/{i}", f"{top}\nown words {i}\nmore own {i}\nand own {i}\n{foot}") for i in range(300)]
    assert [t for _, t, _ in markup._neighbours(iter([]))] == []
    df = spark.createDataFrame(rows, "page_id long, url string, markdown_ir string")
    got = {r.page_id: r.clean_text for r in markup.clean_pages(df).collect()}
    assert got == {i: f"own words {i}\nmore own {i}\nand own {i}" for i in range(300)}
    # the cuts between tasks change nothing
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    assert got == {r.page_id: r.clean_text for r in markup.clean_pages(df.repartition(7)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", old)
    # a page without a neighbour keeps its lines
    assert markup.clean_pages(df.where("page_id = 7")).first().clean_text == rows[7][2]


def test_differencing_keeps_own_content():
    """Fences, headings, delimiters and paragraphs that two pages share stay; their furniture goes."""
    same = ["## What happened next", "```", "<b>shared</b>", "```", "$$", "x^2 + y", "$$", "The ferry did not leave the harbour before noon because of the storm.", "<!--", "Menu", "-->"]
    pages = ["\n".join(["[Home](/) | Search", *(f"Own sentence {k} of page {i}." for k in range(9)), *same, "Back to top"]) for i in range(2)]
    kept = [pages[0].split("\n")[j] for j in markup.own_lines(blocks.GENERAL, pages[0], pages[1:])]
    assert [x for x in kept if not x.startswith("Own")] == same
    # the mask of the whole text: no code shows as markup, no formula is cut
    u = markup._uncoded(pages[0])
    assert len(u.split("\n")) == len(pages[0].split("\n"))
    code = ["\n".join([*(f"Own {k} of {i}." for k in range(5)), "```", f"<b>{i}</b>", "```"]) for i in range(2)]
    assert markup.left_kinds(code[0], code[1:]) == []


def test_kinds_depend_on_differencing():
    """Markup of lines that the nearest other page has too is the site's; the same page again says nothing."""
    page = ["\n".join(["Our &copy; note", *(f"Own line {k} of {i}." for k in range(6)), "and <b>bold</b>" if i else "and plain"]) for i in range(2)]
    assert markup.left_kinds(page[0], []) == ["html"]
    assert markup.left_kinds(page[0], [page[1]]) == []
    assert markup.left_kinds(page[1], [page[0]]) == ["html"]
    assert markup.left_kinds(page[0], [page[0]]) == ["html"]
    assert markup.left_kinds(page[0], [page[0], page[1]]) == []


def test_pages_without_address_and_of_one_address(spark):
    """Rows without url, and fetches of one address, are cut into ranges like others; neighbours do not depend on the cuts."""
    rows = [(i, None, f"Shared line of all\nown {i}\nmore {i}\nlast {i} <i>x</i>") for i in range(200)]
    rows += [(1000 + i, "https://a.test/hot", f"Shared line of all\nown {i}\nmore {i}\nlast {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, markdown_ir string")
    keys = df.where("url is not null").selectExpr("'a.test' as site", "'/hot' as path", "page_id")
    assert len(markup._bounds(keys, 16)) == 15
    got = {r.page_id: r.clean_text for r in markup.clean_pages(df).collect()}
    assert len(got) == 600 and all(got[i].startswith("Shared") for i in range(200))
    assert all(got[1000 + i] == f"own {i}\nmore {i}\nlast {i}" for i in range(400))
    assert ids(markup.markup_kinds(df)) == list(range(200))


# 6
def test_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    rows, pool = [], []
    for i in range(150):
        w = list(rng.choice(pool)) if pool and rng.random() < 0.6 else [f"w{rng.randrange(3000)}" for _ in range(150)]
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        pool.append(w)
        rows.append((i, " ".join(w)))
    rows += [(900, rows[3][1].upper()), (901, rows[3][1]), (902, "short text"), (903, None), (904, ""), (3, rows[3][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "page_id long, markdown_ir string")
    sets = {i: {tuple(t.lower().split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows if t and i is not None and len(t.split()) >= 100}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = [tuple(r) for r in neardup.all_pairs(*neardup.similar(df, "page_id", "markdown_ir", 3, 0.6, 100)).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want)
    root = {i: i for i in {r[0] for r in rows if r[0] is not None}}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(got):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    groups = {r.page_id: r.group_id for r in neardup.groups(df, "page_id", "markdown_ir", 3, 0.6, 100).collect()}
    assert groups == {i: find(i) for i in root}


def test_pairs_take_no_classes_to_the_driver(spark, monkeypatch):
    """Only bitmaps of one size are broadcast, whatever the optimizer takes for small."""
    rng, plans, kept = random.Random(3), [], neardup.saved

    def run(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(neardup, "saved", lambda df: kept(run(df)))
    texts = [[f"w{rng.randrange(3000)}" for _ in range(150)] for _ in range(20)]
    rows = [(i, " ".join([*texts[i % 20][: 150 - 4 * (i // 20)], f"own{i}"])) for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, markdown_ir string")
    run(neardup.all_pairs(*neardup.similar(df, "page_id", "markdown_ir", 3, 0.6, 100)))
    run(neardup.groups(df, "page_id", "markdown_ir", 3, 0.6, 100))
    joins = [x for p in plans for x in p.partition("Initial Plan")[0].split("\n") if "Join" in x]
    assert any("SortMergeJoin" in x for x in joins)
    assert not [x for x in joins if "BroadcastHashJoin" in x and "_bucket" not in x]


@pytest.mark.parametrize("bits", [15, 22])
def test_bitmap_thins(spark, bits):
    from harvestry.llm.text import maybe_among

    df, wanted = spark.range(20_000), spark.range(0, 20_000, 97)
    got = {r.id for r in maybe_among(df, "id", wanted, bits).collect()}
    assert {r.id for r in wanted.collect()} <= got and len(got) < (400 if bits == 15 else 210)
    assert maybe_among(df, "id", wanted.limit(0), bits).count() == 0


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.id: r.root for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 101: 100}
    assert neardup.components(edges.limit(0)).count() == 0


# 7
@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 4000])
@pytest.mark.parametrize("bits", [0, 3, 24])
def test_golomb(n, bits):
    rng = np.random.default_rng(n + bits)
    v = np.unique(rng.integers(0, max(2, n) << bits if bits else max(2, 4 * n), n).astype(np.uint64))
    g = seen.GolombSet(v, bits)
    assert (g.values() == v).all()
    probes = np.sort(np.r_[v[::3], rng.integers(0, max(2, n) << max(2, bits), 500).astype(np.uint64)])
    assert (g.contains(probes) == np.isin(probes, v)).all()
    if n > 1000 and bits:
        assert g.nbytes < len(v) * (bits + 3.5) / 8 + 64


@pytest.mark.parametrize(
    "url,key",
    [(" HTTP://X.Test:80/A?b#c ", "http://x.test/A?b"), ("https://x.test:443", "https://x.test"), ("https://x.test:80/", "https://x.test:80/"), ("x", "x"), ("", ""), (None, None), ("https://U:P@X.test/", "https://U:P@x.test/"), ("ftp://X.test:21/a", "ftp://x.test:21/a")],
)
def test_key(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(seen.key_of(F.col("u"))).first()[0] == key


def test_seen_against_scan(spark):
    rng = random.Random(1)
    u = lambda: f"https://h{rng.randrange(3)}.test/{rng.randrange(300)}"
    items = [(rng.choice(["GET", "POST"]), u()) for _ in range(200)] + [("GET", None), (None, u())]
    tasks = [(i, u() if rng.random() < 0.7 else "https://hot.test/", float(rng.randrange(200))) for i in range(900)]
    tasks += tasks[:30] + [(5000, None, 1.0), (None, u(), 2.0), (5001, "https://hot.test/", None)]
    q = spark.createDataFrame(items, "method string, url string")
    t = spark.createDataFrame(tasks, "task_id long, url string, a double").select("task_id", "url", F.col("a").cast("timestamp").alias("arrived_at"), F.lit(1).alias("shard"))
    known, want = {x for m, x in items if m == "GET" and x}, set()
    for i, x, _ in sorted({r for r in tasks if r[0] is not None and r[1]}, key=lambda r: (r[2] if r[2] is not None else -1e18, r[0])):
        if x in known:
            want.add(i)
        known.add(x)
    assert set(ids(seen.seen_before(q, t))) == want
    assert set(ids(seen.seen_before(q, t, epochs=1))) == want
    assert seen.seen_before(q, t.limit(0)).count() == 0 and seen.seen_before(q.limit(0), t.limit(0)).count() == 0
    r = seen.wrong_answers(q, t, fp_bits=(2,)).first()
    assert r.false_positives >= 0 and 0 <= r.audited_rate <= max(0.9, r.theoretical_rate)
    assert seen.wrong_answers(q, t).where("fp_bits = 24").first().false_positives == 0


def test_seen_rate(spark):
    """The audited rate agrees with the theoretical one where false positives are many enough to count."""
    q = spark.range(20_000).selectExpr("'GET' as method", "concat('https://a.test/', id) as url")
    t = spark.range(40_000).selectExpr("id as task_id", "concat('https://b.test/', id) as url", "timestamp_seconds(id) as arrived_at")
    r = {x.fp_bits: x for x in seen.wrong_answers(q, t, fp_bits=(6, 24)).collect()}
    assert r[6].false_positives > 200 and 0.8 < r[6].audited_rate / r[6].theoretical_rate < 1.25
    assert r[24].false_positives == 0 and r[24].theoretical_rate < 1e-6


def test_sets_stream(monkeypatch):
    """A set coded as it streams by holds what one coded at once does, whatever the sizes of batches and chunks."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(seen, "CHUNK", 500)
    keys = seen.SeenKeys(12)
    parts = [np.unique(rng.integers(0, 1 << 26, 7000).astype(np.uint64)) for _ in range(3)]
    for v in parts:
        for i in range(0, len(v), 333):
            keys.add(v[i : i + 333])
        keys.close()
    every = np.unique(np.concatenate(parts))
    probes = np.unique(np.r_[every[::7], rng.integers(0, 1 << 26, 3000).astype(np.uint64)])
    assert (keys.seen(probes) == np.isin(probes, every)).all()
    assert max(s.n for chunks in keys.sets for s in chunks) <= 500


# 8
def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, bucket string")


def test_packing(spark):
    rng = random.Random(6)
    texts = ["word " * rng.randrange(1, 120) for _ in range(400)] + ["", None, "long " * 3000]
    docs, specs = _docs(spark, texts), spark.createDataFrame([(1, "a", 64), (2, "b", 256), (3, "bad", 0), (None, "c", 5)], "spec_id int, spec_name string, capacity_tokens int")
    docs = docs.union(docs.limit(5))
    rows = packing.packed(docs, specs).collect()
    size = {r.doc_id: r.tokens for r in tokens.token_sizes(docs).collect()}
    for spec, cap in ((1, 64), (2, 256)):
        mine = [r for r in rows if r.spec_id == spec]
        per, parts = Counter(), defaultdict(list)
        for r in mine:
            per[r.container_id] += r.tokens
            parts[r.doc_id].append((r.part, r.tokens))
        assert max(per.values()) <= cap
        assert {i: sum(t for _, t in p) for i, p in parts.items()} == size
        assert all((len(p) == 1) == (size[i] <= cap) and sorted(x for x, _ in p) == list(range(len(p))) for i, p in parts.items())
        least = -(-sum(size.values()) // cap)
        assert len(per) <= least * 1.03 + 2
    assert {r.spec_id for r in rows} == {1, 2}
    assert packing.fill(packing.packed(docs, specs), specs).where("overfull > 0").count() == 0
    assert packing.packed(docs.limit(0), specs).count() == 0 and packing.packed(docs, specs.limit(0)).count() == 0


def test_plan_uses_all():
    rng = np.random.default_rng(0)
    for cap in (1, 2, 10, 100, 3000):
        counts = np.r_[0, rng.integers(0, 50, cap)]
        used = np.zeros(cap + 1, np.int64)
        for pattern, times in packing.plan(counts, cap):
            assert sum(x * k for x, k in pattern.items()) <= cap and times > 0
            for x, k in pattern.items():
                used[x] += k * times
        assert (used == counts).all()


def test_plan_is_no_worse_than_greedy():
    rng = np.random.default_rng(1)
    for cap in (64, 256, 512):
        counts = np.r_[0, rng.integers(0, 40, cap)]
        ways = [sum(times for _, times in w) for w in packing.plans(counts, cap)]
        assert sum(times for _, times in packing.plan(counts, cap)) == min(ways) <= ways[-1]


def test_nnls():
    rng = np.random.default_rng(3)
    a = rng.random((12, 20))
    x = packing.nnls(a, a @ np.maximum(rng.normal(size=20), 0))
    grad = a.T @ (a @ x) - a.T @ (a @ np.zeros(20))
    assert (x >= 0).all() and np.isfinite(grad).all()
    b = a @ np.maximum(rng.normal(size=20), 0)
    x = packing.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert g.max() < 1e-6 and abs((g * x).sum()) < 1e-6


# 9
def test_mixing(spark):
    rng = random.Random(8)
    names = ["Big Source", "big-source", " big_source", "small", "SMALL", "mid", None, "other"]
    docs = spark.createDataFrame([(i, "word " * rng.randrange(0, 60), rng.choices(names, [30, 5, 5, 4, 2, 20, 3, 3])[0], 1) for i in range(3000)], "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small", 0.3, 4), ("mid", 0.15, 2), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(docs, targets)
    rows = {r.source: r for r in mixing.shares(mix, targets).collect()}
    for s, share in (("big_source", 0.5), ("small", 0.3), ("mid", 0.15)):
        assert rows[s].actual_share == pytest.approx(share / 0.95, abs=0.003)
        assert rows[s].most_copies <= rows[s].max_repeats
    assert rows["absent"].actual_share == 0 and mix.count() == mix.select("doc_id").distinct().count()
    fixed = mixing.mixed(docs, targets, total=10_000).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert fixed == pytest.approx(10_000, rel=0.02)
    assert mixing.mixed(docs.limit(0), targets).count() == 0 and mixing.mixed(docs, targets.limit(0)).count() == 0


def test_tokens(spark):
    rows = {r.doc_id: r.tokens for r in tokens.token_sizes(_docs(spark, ["a b c", "", None, "日本語"])).collect()}
    assert rows[0] == 3 and rows[1] == rows[2] == 0 and rows[3] > 0


# 10
@pytest.mark.parametrize(
    "text,units",
    [
        ("One. Two? Three!", ["One.", "Two?", "Three!"]),
        ("Dr. Lee and Prof. Ng met at 10 a.m. and left. See Fig. 2 and Sec. 3.1 (cf. No. 4). J. R. Lee wrote it.", ["Dr. Lee and Prof. Ng met at 10 a.m. and left.", "See Fig. 2 and Sec. 3.1 (cf. No. 4).", "J. R. Lee wrote it."]),
        ("They moved to the U.S. What now? In the U.S. and elsewhere.", ["They moved to the U.S.", "What now?", "In the U.S. and elsewhere."]),
        ("It ended at 11 p.m. The cost fell by .5 points to 3.2%. It took 13 days, etc. 4 men came.", ["It ended at 11 p.m.", "The cost fell by .5 points to 3.2%.", "It took 13 days, etc.", "4 men came."]),
        ("Kvikk! is the fetcher. He waited ... and left... She came.", ["Kvikk! is the fetcher.", "He waited ... and left...", "She came."]),
        ("It stopped. eFetch ran. robots.txt listed 3.", ["It stopped.", "eFetch ran.", "robots.txt listed 3."]),
        ('She said: "It rained. It poured." Then it stopped. "Go on. Now," said Lee, who left.', ['She said: "It rained. It poured."', "Then it stopped.", '"Go on. Now," said Lee, who left.']),
        ("“It rained! Did it?” Lee asked before noon. (It was kept. So.) Next.", ["“It rained! Did it?” Lee asked before noon.", "(It was kept. So.)", "Next."]),
        ("Der Wert lag bei 0,5 MB, d. h. rund 3 Seiten, z. B. im Keller. Am 3. Mai kam die Fa. Lee & Co. KG. »Wie leer!«, rief sie.", ["Der Wert lag bei 0,5 MB, d. h. rund 3 Seiten, z. B. im Keller.", "Am 3. Mai kam die Fa. Lee & Co. KG.", "»Wie leer!«, rief sie."]),
        ("M. Lee a fermé le quai à 3 h. précises. Voir fig. 2 et p. 3. Pourquoi ? « Oui. Non », dit Lee.", ["M. Lee a fermé le quai à 3 h. précises.", "Voir fig. 2 et p. 3.", "Pourquoi ?", "« Oui. Non », dit Lee."]),
        ("La Dra. Lee viajó a EE. UU. con él. ¿Por qué? ¡Qué día! Véase la pág. 3.", ["La Dra. Lee viajó a EE. UU. con él.", "¿Por qué?", "¡Qué día!", "Véase la pág. 3."]),
        ("Были ссылки, формы и т. д. База закрыта. См. рис. 2, т. е. 5 минут. «Да. Нет», — сказал Lee.", ["Были ссылки, формы и т. д.", "База закрыта.", "См. рис. 2, т. е. 5 минут.", "«Да. Нет», — сказал Lee."]),
        ("版本1.8用了7.4秒。为什么？《Lee手册》里写着3条……但没有看。“一。二。”Lee说。完。", ["版本1.8用了7.4秒。", "为什么？", "《Lee手册》里写着3条……但没有看。", "“一。二。”Lee说。", "完。"]),
        ("差は9.5倍だった。「一。二。」とLeeは話した。『三』という題。", ["差は9.5倍だった。", "「一。二。」とLeeは話した。", "『三』という題。"]),
        ("د. Lee نقل المخزن. لماذا؟ قال Lee: «واحد. اثنان.» ثم ذهب.", ["د. Lee نقل المخزن.", "لماذا؟", "قال Lee: «واحد. اثنان.»", "ثم ذهب."]),
        ("डॉ. Lee ने सूची जाँची। “एक। दो।” Lee ने कहा। क्यों?", ["डॉ. Lee ने सूची जाँची।", "“एक। दो।” Lee ने कहा।", "क्यों?"]),
        ("ระบบพบ 912 หน้า โปรแกรม Lee ทำให้ช้า คิวยังว่างตั้งแต่ปี 2006 ทีมงานบอกว่า “หนึ่ง สอง” จบ", ["ระบบพบ 912 หน้า", "โปรแกรม Lee ทำให้ช้า", "คิวยังว่างตั้งแต่ปี 2006", "ทีมงานบอกว่า “หนึ่ง สอง”", "จบ"]),
        ("A head\n\n- one. two.\n- three\n1. four\nfive\n\nThe end\nof it. Done.", ["A head", "- one. two.", "- three", "1. four\nfive", "The end\nof it.", "Done."]),
        ("It rained.Then it stopped. See https://x.test/a.b?c=1.2 first. A file index.v6.html is there.", ["It rained.", "Then it stopped.", "See https://x.test/a.b?c=1.2 first.", "A file index.v6.html is there."]),
        ("Il faut 3 minutes.« Le club attend », dit Lee. Fin.", ["Il faut 3 minutes.", "« Le club attend », dit Lee.", "Fin."]),
        ("No end", ["No end"]),
        ("", []),
        (None, []),
        (" \n\n \n", []),
        ('An " odd mark. Fine (open. So.', ['An " odd mark.', "Fine (open.", "So."]),
    ],
)
def test_sentences(text, units):
    assert [text[a:b] for a, b in sentences.units(text)] == units


def test_sentences_odd(spark):
    docs = spark.createDataFrame([(1, "One. Two.", 0), (1, "One. Two.", 0), (2, None, 0), (3, "", 0), (None, "x.", 0), (4, "a. B " * 50_000, 0)], "doc_id long, text string, start_pos int")
    got = Counter(r.doc_id for r in sentences.sentence_units(docs).collect())
    assert got[1] == 2 and set(got) == {1, 4} and got[4] == 50_001 - 0 or got[4] > 0
    assert sentences.sentence_units(docs.limit(0)).count() == 0


def test_units_are_in_order_and_cover():
    rng = random.Random(0)
    bits = list("aB .!?\n\"“”„«»()。「」…-1Ж") + ["Dr.", "etc. ", "\n\n", "- ", "ปี 2006 ", "ก "]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        u = sentences.units(t)
        assert all(a < b for a, b in u) and all(x[1] <= y[0] for x, y in zip(u, u[1:]))
        covered = {i for a, b in u for i in range(a, b)}
        assert all(c.isspace() or i in covered for i, c in enumerate(t)), repr(t)
        assert all(not t[a].isspace() and not t[b - 1].isspace() for a, b in u), repr(t)


@pytest.mark.parametrize(
    "text,n",
    [
        ("He met Sen. Smith there. It rained.", 2),
        ("See Eq. 5 for it. It holds.", 2),
        ("Selon L'art. 5 il faut payer. Il pleut.", 2),
        ("The U.S. Senate met. It rained.", 2),
        ("They moved to the U.S. Nobody knew.", 2),
        ("ܐܒܓ܀ ܕܗܘ܀", 2),
        ("ߊߋߌ߹ ߍߎ߹", 2),
    ],
)
def test_more_boundaries(text, n):
    assert len(sentences.units(text)) == n


def test_terminators_come_from_the_property():
    assert {"؝", "܀", "߹", "࠷", "᜵", "᭽", "⳹", "︒", "﹖", "\U00011047"} <= set(sentences.STERM)


def test_long_paragraphs_are_linear():
    """Marks without a partner, however many, do not make a long paragraph slow."""
    import time

    for mark in ("(", "“", "„", "( „"):
        took = []
        for n in (4_000, 32_000):
            t = f"a {mark}b c. " * n
            began = time.perf_counter()
            sentences.units(t)
            took.append(time.perf_counter() - began)
        assert took[1] < 30 * took[0] + 0.5
