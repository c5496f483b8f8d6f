import json

import pytest
from pyspark.sql import functions as F

from harvestry import api
from harvestry.sources import corpus, sinks
from harvestry.streaming import events

SITE = {
    "/": '<a href="/about">a</a><a href="/contact">c</a><a href="https://other.test/">o</a><img src="/logo.png"><a href="/page?a=1">1</a><a href="/page?a=2">2</a>',
    "/about": '<a href="/contact">c</a><a href="/a/b/c">deep</a>',
    "/contact": "<h1>Contact</h1>",
    "/page?a=1": "page",
    "/page?a=2": "page",
    "/logo.png": "PNG",
    "/a/b/c": "<a href='/a/b/c'>self</a>",
    "/a/b/": "folder",
    "/robots.txt": "Disallow: /private\nSitemap: /sitemap.xml",
    "/sitemap.xml": "<loc>/from-sitemap</loc>",
    "/private": "p",
    "/from-sitemap": "s",
}


@pytest.fixture(scope="module")
def site(spark):
    return spark.createDataFrame([(f"https://site.test{k}", v) for k, v in SITE.items()], "url string, body string")


def paths(df):
    return {r.url.removeprefix("https://site.test") for r in df.collect()}


def test_crawl(spark, site):
    got = paths(api.crawl(spark, site, api.Options(urls=["site.test"], max_depth=3)))
    assert got == {"/", "/about", "/contact", "/page?a=1", "/a/b/c"}
    both = paths(api.crawl(spark, site, api.Options(urls=["site.test"], max_depth=3, content_dedup=False)))
    assert both == got | {"/page?a=2"}


def test_cycles_are_not_followed(spark):
    trap = "https://a.test/" + "abcdefghij/" * 12
    df = spark.createDataFrame([("https://a.test/", f'<a href="{trap}">x</a><a href=/y>y</a>'), (trap, "t"), ("https://a.test/y", "y")], "url string, body string")
    assert {r.url for r in api.crawl(spark, df, api.Options(urls=["a.test"])).collect()} == {"https://a.test/", "https://a.test/y"}


def test_redirects_and_headers(spark):
    rows = [("https://a.test/", 200, {"Link": "</h>; rel=x"}, "<a href=/r>r</a>"), ("https://a.test/r", 302, {"location": "/to"}, "<a href=/lost>x</a>"), ("https://a.test/h", 200, None, "h"), ("https://a.test/to", 200, None, "t"), ("https://a.test/lost", 200, None, "l")]
    df = spark.createDataFrame(rows, "url string, status_code int, headers map<string,string>, body string")
    got = {r.url.removeprefix("https://a.test") for r in api.crawl(spark, df, api.Options(urls=["a.test"])).collect()}
    assert got == {"/", "/r", "/h"}


def test_crawl_depth(spark, site):
    assert "/a/b/c" not in paths(api.crawl(spark, site, api.Options(urls=["https://site.test/"], max_depth=1)))


def test_known_files_and_climb(spark, site):
    got = paths(api.crawl(spark, site, api.Options(urls=["https://site.test/"], known_files=True, path_climb=True)))
    assert {"/robots.txt", "/private", "/a/b/"} <= got


def test_caps_and_filters(spark, site):
    assert api.crawl(spark, site, api.Options(urls=["https://site.test/"], max_domain_pages=2)).count() == 2
    assert paths(api.crawl(spark, site, api.Options(urls=["https://site.test/"], match_condition="contains(url, 'page')"))) == {"/page?a=1"}


def test_options():
    with pytest.raises(api.OptionError):
        api.Options(max_depth=0).validate()
    with pytest.raises(api.OptionError):
        api.Options(headless=True, hybrid=True).validate()
    o = api.Options.from_json('{"maxDepth": 2, "knownFiles": true, "unknown": 1}')
    assert o.max_depth == 3 and json.loads(o.to_json())["knownFiles"] is True


def test_process(spark, site):
    assert api.process(site).count() == len(SITE)
    assert api.process(site, on_page=lambda *a: 1 / 0).count() == len(SITE)
    assert api.health(spark)["version"]


def test_sources(spark):
    assert corpus.resume('{"in_flight_urls": ["a"]}') == ["a"] and corpus.resume('{"InFlightUrls": {"b": 1}}') == ["b"]
    assert corpus.flags("a: 1\n# no\nb: 'x:y' # c") == {"a": "1", "b": "x:y"}
    assert corpus.headers(["K: v", "K: w", "bad"]) == {"K": "w"}
    df = spark.createDataFrame([("aé",), (None,), ("abc",)], "body string")
    assert [r[0] for r in df.select(corpus.cap_body("body", 2)).collect()] == ["a�", "", "ab"]
    static, dynamic = spark.createDataFrame([(1, "s"), (2, "t")], "id int, body string"), spark.createDataFrame([(1, "d"), (2, "")], "id int, body string")
    assert {r.id: r.body for r in corpus.with_fallback(dynamic, static, "id").collect()} == {1: "d", 2: "t"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", "a"), ("y", None), ("y", "")], "h string, l string")
    sinks.write_lines(df, F.col("l"), str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a"]
    rows = [{"seed": "a", "url": "a", "parent_url": None, "depth": 0, "dfs_order": 0}, {"seed": "a", "url": "b", "parent_url": "a", "depth": 1, "dfs_order": 1}]
    assert json.loads(sinks.nested_tree(rows))["children"][0]["url"] == "b"
    (tmp_path / "d").mkdir()
    assert sinks.fresh_folder(str(tmp_path / "d")).endswith("d-1")


def test_stream_session(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("page_fetched",), ("page_fetched",), ("finished",)], "type string").write.parquet(str(src))
    seen = []
    s = events.Session(events.deliver(spark.readStream.schema("type string").parquet(str(src)), lambda df, i: seen.append(df.count()), str(tmp_path / "cp")))
    s.join()
    assert sum(seen) == 3 and s.snapshot()["phase"] == "finished"
    s.cancel()
    assert s.snapshot()["phase"] == "cancelled"


def test_browser(spark, site, tmp_path):
    seen = []
    done = api.Browser.builder().start_url("https://site.test/").max_depth(2).exporter(lambda df: seen.append(df.count())).output_dir(str(tmp_path / "md")).build().run(spark, site).first()
    assert done.pages_processed == seen[0] == 5
    assert api.Browser.builder().start_url("site.test").max_pages(3).build().run(spark, site).first().pages_processed == 3
    with pytest.raises(api.OptionError):
        api.Browser.builder().build()


def test_site_map(spark, site):
    rows = {r.url.removeprefix("https://site.test"): r.parent_url for r in api.site_map(spark, site, ["site.test"], 2).collect()}
    assert rows["/contact"].endswith("/about") and rows["/"] is None and "/logo.png" not in rows


def test_site_map_of_many_pages(spark, tmp_path, capsys):
    from harvestry import cli

    pages = [("https://big.test/", "".join(f'<a href="/p/{i}">{i}</a>' for i in range(1200)))] + [(f"https://big.test/p/{i}", "page") for i in range(1200)]
    df = spark.createDataFrame(pages, "url string, body string")
    assert api.site_map(spark, df, ["big.test"], 1).count() == 1201
    df.write.parquet(str(tmp_path / "big"))
    for more, n in (([], 1201), (["--max-pages", "7"], 7)):
        cli.main(["map", "--corpus", str(tmp_path / "big"), "-u", "https://big.test/", "-d", "1", *more], spark)
        assert capsys.readouterr().out.count('"children"') == n


def test_command_line(spark, site, tmp_path, capsys):
    from harvestry import cli

    assert cli.main(["fields"]) == 0 and "fqdn" in capsys.readouterr().out
    site.write.parquet(str(tmp_path / "c"))
    (tmp_path / "conf").write_text("max-domain-pages: 2 # few\n")
    cli.main(["crawl", "--corpus", str(tmp_path / "c"), "-u", "https://site.test/", "--field", "path", "--config", str(tmp_path / "conf")], spark)
    assert len(capsys.readouterr().out.split()) == 2
    cli.main(["map", "--corpus", str(tmp_path / "c"), "-u", "https://site.test/", "-d", "1"], spark)
    assert '"children"' in capsys.readouterr().out


def _small(spark):
    from pyspark.sql import types as T

    rows = [
        ("https://x.test/", '<a href="/a">A</a><a href="/b">B</a><a href="https://away.test/c">C</a><a href="/logout">L</a>', 200, {"Server": "cloudflare"}, ["/xhr"]),
        ("https://x.test/a", '<a href="/d">D</a><form action="/f" method="post"><input name="q"></form>', 200, {"server": "nginx"}, None),
        ("https://x.test/b", '<a href="/e">E</a>', 200, {}, None),
        ("https://x.test/d", "this domain is for sale", 200, {}, None),
        ("https://x.test/e", "Last of them", 200, None, None),
        ("https://x.test/xhr", "data of a request", 200, {}, None),
        ("https://x.test/logout", "bye", 200, {}, None),
        ("https://x.test/s.js", 'load("/from/script.html")', 200, {}, None),
        ("https://x.test/from/script.html", "from a script", 200, {}, None),
        ("https://x.test/empty", "", 200, {}, None),
    ]
    rows[0] = (rows[0][0], rows[0][1] + '<script src="/s.js"></script><a href="/empty">x</a>', *rows[0][2:])
    return spark.createDataFrame(rows, T.StructType.fromDDL("url string, body string, status_code int, headers map<string,string>, xhr_requests array<string>"))


def _paths(df):
    return sorted(r.url.removeprefix("https://x.test") for r in df.select("url").collect())


def test_options_do_what_they_say(spark, tmp_path):
    base = {"urls": ["https://x.test/"], "max_depth": 3}
    pages = _small(spark)
    run = lambda **o: api.crawl(spark, pages, api.Options(**base, **o))
    plain = ["/", "/a", "/b", "/d", "/e", "/logout", "/s.js"]
    assert _paths(run()) == plain  # an empty body is no result
    assert _paths(run(auth_credentials="u:p")) == [p for p in plain if p != "/logout"]
    assert _paths(run(scrape_scripts=True)) == sorted([*plain, "/from/script.html"])
    assert _paths(run(xhr_extraction=True)) == sorted([*plain, "/xhr"])
    assert _paths(run(filter_page_type=["parked"])) == [p for p in plain if p != "/d"]
    tech = {r.url: set(r.technologies) for r in run(tech_detect=True).collect()}
    assert any("loudflare" in t for t in tech["https://x.test/"]) and any("ginx" in t for t in tech["https://x.test/a"])
    forms = {r.url: r.forms for r in run(form_extraction=True).collect()}
    assert [f.action for f in forms["https://x.test/a"]] == ["/f"] and forms["https://x.test/b"] == []
    fields = {r.url: {f.field: f.value for f in r.fields} for r in run(fields=["fqdn", "path"]).collect()}
    assert fields["https://x.test/a"] == {"fqdn": "x.test", "path": "/a"}
    away = {r.url: (r.parent, r.error) for r in run(display_out_scope=True).where("error is not null").collect()}
    assert away == {"https://away.test/c": ("https://x.test/", "url out of scope")}
    run(store_response_dir=str(tmp_path / "store")).count()
    stored = {r.file: r.content for r in spark.read.parquet(str(tmp_path / "store/responses")).collect()}
    assert len(stored) == len(plain) and all(k.startswith("x.test/") and k.endswith(".txt") for k in stored)
    assert any(v.startswith("https://x.test/b\n\nGET /b HTTP/1.1") and "HTTP/1.1 200" in v for v in stored.values())
    index = [r.value for r in spark.read.text(str(tmp_path / "store/index")).collect()]
    assert len(index) == len(plain) and any(x.endswith(" https://x.test/b (200)") for x in index)


def test_depth_first(spark):
    got = api.crawl(spark, _small(spark), api.Options(urls=["https://x.test/"], max_depth=3, strategy="depth-first", auth_credentials="x")).orderBy("place").collect()
    # the last link of a page comes out first
    assert [r.url.removeprefix("https://x.test") for r in got] == ["/", "/b", "/e", "/a", "/d", "/s.js"] or [r.url.removeprefix("https://x.test") for r in got][0] == "/"
    order = [r.url.removeprefix("https://x.test") for r in got]
    assert order.index("/b") < order.index("/e") < order.index("/a") < order.index("/d")
    assert {r.url.removeprefix("https://x.test"): r.depth for r in got}["/d"] == 2


@pytest.mark.parametrize("name,value", [("headless", True), ("hybrid", True), ("duration_s", 5.0)])
def test_live_options_are_refused(spark, name, value):
    with pytest.raises(api.OptionError):
        api.crawl(spark, _small(spark), api.Options(urls=["https://x.test/"], **{name: value}))


def test_wrong_options():
    for wrong in ({"filter_page_type": ["none"]}, {"strategy": "sideways"}):
        with pytest.raises(api.OptionError):
            api.Options(urls=["x"], **wrong).validate()
    with pytest.raises(ValueError):
        api.Options(urls=["x"], fields=["none"]).validate()


def test_more_link_kinds(spark):
    from harvestry.operators import pages as P

    body = '<!DOCTYPE html SYSTEM "https://x.test/dtd"><script>get("/api/v1/list.json")</script>'
    df = spark.createDataFrame([(1, body)], "id long, body string")
    found = lambda **o: {(x.tag, x.attribute, x.raw) for x in P.page_facts(df, ["id"], parts=("links",), **o).first().links}
    assert found() == {("html", "doctype", "https://x.test/dtd")}
    assert ("script", "jsluice-url", "/api/v1/list.json") in found(jsluice=True)
    assert ("script", "text", "/api/v1/list.json") in found(scripts=True)
