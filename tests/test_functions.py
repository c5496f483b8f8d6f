import pytest
from pyspark.sql import functions as F

from harvestry.functions import html as H
from harvestry.functions import urls as U


def one(spark, c, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(c.alias("x")).first()[0]


@pytest.mark.parametrize(
    "url,normal",
    [
        ("HTTP://Example.COM:80/a/../b/./c?q=1#f", "http://example.com/b/c?q=1#f"),
        ("https://x.test:443", "https://x.test/"),
        ("https://x.test:8443/", "https://x.test:8443/"),
        ("https://x.test/für", "https://x.test/f%C3%BCr"),
        ("https://x.test/a/..", "https://x.test/"),
        ("https://x.test/../../a", "https://x.test/a"),
        ("  https://x.test/a \n", "https://x.test/a"),
        ("https://u:p@X.test/a,b", "https://x.test/a,b"),
        ("nothing", None),
        (None, None),
        ("", None),
    ],
)
def test_normalize(spark, url, normal):
    assert one(spark, U.normalize("u"), u=url) == normal


@pytest.mark.parametrize(
    "base,ref,out",
    [
        ("https://x.test/a/b", "/c", "https://x.test/c"),
        ("https://x.test/a/b", "c", "https://x.test/a/c"),
        ("https://x.test/a/b", "../c", "https://x.test/c"),
        ("https://x.test/a/b?q=1", "?z=2", "https://x.test/a/b?z=2"),
        ("https://x.test/a/b", "//y.test/c", "https://y.test/c"),
        ("https://x.test/a/b", "https://y.test/c#f", "https://y.test/c"),
        ("https://x.test/a/b", "#f", ""),
        ("https://x.test/a/b", "", ""),
        ("https://x.test/a/b", None, ""),
        (None, "/c", ""),
        ("https://x.test/a", "mailto:a@b.test", ""),
    ],
)
def test_join(spark, base, ref, out):
    assert one(spark, U.join("b", "r"), b=base, r=ref) == out
    df = spark.createDataFrame([(base, ref)], "b string, r string")
    assert U.joined(df, "x", "b", "r").first()["x"] == out


@pytest.mark.parametrize("host,out", [("a.b.example.com", "example.com"), ("a.b.co.uk", "b.co.uk"), ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1"), ("co.uk", "co.uk")])
def test_registrable_domain(spark, host, out):
    assert one(spark, U.registrable_domain("h"), h=host) == out


def test_suffix_list(spark, tmp_path):
    (tmp_path / "s").write_text("// list\ntest\na.test\n*.b.test\n!c.b.test\nx.y.test\n")
    found = U.load_suffixes(str(tmp_path / "s"))
    assert found == {"a.test"} and one(spark, U.registrable_domain("h", found), h="w.v.a.test") == "v.a.test"


@pytest.mark.parametrize("p,file,folder,ext", [("/a/b.tar.gz", "b.tar.gz", "/a/", ".gz"), ("/a", "", "", ""), ("/", "", "", ""), ("/a/b/", "", "/a/b/", ""), ("/.htaccess", ".htaccess", "", ""), ("/x.JS", "x.JS", "", ".js")])
def test_path_parts(spark, p, file, folder, ext):
    r = spark.createDataFrame([(p,)], "p string").select(U.file_base("p"), U.directory("p"), U.extension("p")).first()
    assert tuple(r) == (file, folder, ext)


@pytest.mark.parametrize("text,seconds", [("", 0.0), ("1h30m", 5400.0), ("250ms", 0.25), ("1.5s", 1.5), ("2d", 172800.0), ("soon", None), ("5", None)])
def test_duration(spark, text, seconds):
    assert one(spark, U.duration_seconds("t"), t=text) == (pytest.approx(seconds) if seconds is not None else None)


def test_sorted_query(spark):
    assert one(spark, U.sorted_query_path("u"), u="https://x.test/p?b=2&a=1&b=1") == "/p?a=1&b=2&b=1"


PAGE = """<!doctype html><html><head><title> A &amp; B </title><script>var a = "/api/list.json";</script></head>
<body><nav><a href="/one">One</a><a href='#x'>x</a></nav><h1>Top</h1><p>First <b>bold<p>Second
<ul><li>a<li>b</ul><div><span>inner</span></div><div>plain</div><span>free</span><pre>x = 1</pre><code>y</code>
<img src="/i.png" srcset="/j.png 1x, /k.png 2x"><form method=post action="/go"><input name=q value=1><select name=s><option value=u><option value=v selected></select></form>
<blockquote cite="/c">said</blockquote><script>fetch("/x/y.json")</script><a hx-get="/h">h</a></body></html>"""


def test_tree():
    root = H.parse(PAGE)
    assert H.title(root) == "A & B"
    got = H.links(root, scripts=True)
    assert ("a", "href", "GET", "/one") in got and ("img", "srcset", "GET", "/k.png") in got
    assert ("htmx", "hx-get", "GET", "/h") in got and ("script", "text", "GET", "/x/y.json") in got
    assert got.index(("a", "href", "GET", "/one")) < got.index(("blockquote", "cite", "GET", "/c")) < got.index(("img", "src", "GET", "/i.png"))
    assert H.forms(root) == [("POST", "/go", "application/x-www-form-urlencoded", ["q", "s"])]
    assert H.filled_requests(root) == [("POST", "/go", "q=1&s=v", "application/x-www-form-urlencoded")]
    md = H.markdown(root)
    assert "\n# Top\n" in md and "* a\n* b\n" in md and "\n```\nx = 1\n```\n" in md and " `y` " in md and "free\n\n" in md
    assert "[One](/one)\n" in md and "[x]" not in md and "First bold\n\n" in md and "Second\n\n" in md


@pytest.mark.parametrize("body", ["", "<", "<p", "<a href=", "<script>", "&", "<!--", "<table><tr><td>x<td>y", "\x00", "<p>" * 500])
def test_broken_pages(body):
    root = H.parse(body)
    assert H.title(root) == "Untitled Page"
    H.links(root), H.forms(root), H.markdown(root)


def test_valid():
    assert H.valid(" /a ") and not H.valid("JavaScript:x") and not H.valid("  ") and not H.valid("data:1")


def test_lambda_arguments(spark):
    # functions given to transform must take one argument
    df = spark.createDataFrame([([" a", "b "],)], "x array<string>")
    assert df.select(F.transform("x", lambda v: F.trim(v))).first()[0] == ["a", "b"]
