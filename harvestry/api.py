"""Public interface: options, the crawl over a corpus, the page pipeline, callbacks."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import urls as U
from .operators import analyze, cycles, dedup, dsl, extract, filters, frontier, output, pages
from .plans.lineage import saved, where_once


class OptionError(ValueError):
    """Options that do not go together."""


@dataclass
class Options:
    """What a crawl over a corpus is told; names in JSON are camelCase."""

    urls: list[str] = field(default_factory=list)
    max_depth: int = 3
    duration_s: float = 0.0
    scope: str = "rdn"
    no_scope: bool = False
    in_scope: list[str] = field(default_factory=list)
    out_scope: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    extension_match: list[str] = field(default_factory=list)
    extension_filter: list[str] = field(default_factory=list)
    known_files: bool = False
    ignore_query: bool = False
    path_climb: bool = False
    disable_redirects: bool = False
    scrape_scripts: bool = False
    scrape_jsluice: bool = False
    xhr_extraction: bool = False
    auth_credentials: str = ""
    display_out_scope: bool = False
    max_domain_pages: int = 0
    match_regex: list[str] = field(default_factory=list)
    filter_regex: list[str] = field(default_factory=list)
    match_condition: str = ""
    filter_condition: str = ""
    filter_page_type: list[str] = field(default_factory=list)
    tech_detect: bool = False
    knowledge_base: bool = False
    form_extraction: bool = False
    fields: list[str] = field(default_factory=list)
    store_response: bool = False
    store_response_dir: str = ""
    headless: bool = False
    hybrid: bool = False
    strategy: str = "breadth-first"
    content_dedup: bool = True

    def validate(self) -> Options:
        if self.max_depth <= 0 and self.duration_s <= 0:
            raise OptionError("either a depth or a duration is required")
        if self.headless and self.hybrid:
            raise OptionError("headless and hybrid exclude each other")
        if self.strategy not in ("breadth-first", "depth-first"):
            raise OptionError(f"unknown strategy {self.strategy}")
        unknown = set(self.filter_page_type) - set(filters.PAGE_TYPES)
        if unknown:
            raise OptionError(f"unknown page types {sorted(unknown)}")
        if self.fields:
            output.check_field_names(self.fields)
        import re

        for p in [*self.in_scope, *self.out_scope, *self.match_regex, *self.filter_regex]:
            re.compile(p)
        if self.known_files and self.max_depth < 3:
            self.max_depth = 3
        if self.store_response_dir:
            self.store_response = True
        return self

    @classmethod
    def from_json(cls, text: str) -> Options:
        camel = {"".join(w if i == 0 else w.title() for i, w in enumerate(f.name.split("_"))): f.name for f in fields(cls)}
        return cls(**{camel[k]: v for k, v in json.loads(text).items() if k in camel}).validate()

    def to_json(self) -> str:
        return json.dumps({"".join(w if i == 0 else w.title() for i, w in enumerate(f.name.split("_"))): getattr(self, f.name) for f in fields(self)})


def crawl(spark: SparkSession, corpus: DataFrame, options: Options) -> DataFrame:
    """Rows of the corpus (url, body, ...) that a crawl from options.urls reaches, with depth and parent.

    The corpus is parsed once, links are columns, and the traversal is a fixpoint of joins.  Options that only steer live
    fetching are refused.  strategy "depth-first" gives the order of a last-in-first-out queue (`place`), a seed in one task.
    """
    o = options.validate()
    for name in ("headless", "hybrid", "duration_s"):
        if getattr(o, name):
            raise OptionError(f"{name} needs live fetching; a corpus is stored")
    seeds = spark.createDataFrame([(i, u) for i, u in enumerate(o.urls)], "ord long, url string").select(U.normalize(U.with_scheme(F.trim("url")), keep_fragment=False, keep_query=not o.ignore_query).alias("url"))
    if o.exclude:
        seeds = seeds.where(filters.not_excluded("url", o.exclude))
    given = [c for c in ("body", "status_code", "headers", "xhr_requests") if c in corpus.columns]
    base = corpus.withColumn("_url", U.normalize("url", keep_fragment=False, keep_query=not o.ignore_query)).where("_url is not null")
    # of several rows with one address the first by (address as written, body)
    base = base.groupBy("_url").agg(F.min_by(F.struct(*given), F.struct("url", "body")).alias("r")).select(F.col("_url").alias("source"), "r.*")
    follow = base.where(~F.coalesce(U.is_redirect("status_code"), F.lit(False))) if "status_code" in given else base
    facts = pages.page_facts(follow, ["source"], parts=("links",), scripts=o.scrape_scripts, jsluice=o.scrape_jsluice)
    links = pages.link_rows(facts, ["source"], "source").select("source", "ord", "url")
    if o.scrape_scripts or o.scrape_jsluice:
        found = extract.script_file_links(follow, "source", "source", "body", "headers" if "headers" in given else None)
        links = links.union(U.joined(found, "url", "source", "raw").select("source", F.lit(50_000).alias("ord"), "url"))
    if o.xhr_extraction and "xhr_requests" in given:
        found = follow.select("source", F.posexplode("xhr_requests").alias("ord", "raw"))
        links = links.union(U.joined(found, "url", "source", "raw").select("source", F.col("ord") + 60_000, "url"))
    if "headers" in given:
        found = extract.header_links(follow, "source", follow=not o.disable_redirects)
        links = links.union(U.joined(found, "url", "source", "raw").select("source", F.lit(-1).alias("ord"), "url"))
    if o.ignore_query:
        links = links.withColumn("url", F.regexp_replace("url", r"\?.*$", ""))
    links = where_once(links, F.col("url") != "")
    if o.path_climb:
        up = links.select("source", F.col("ord") + 100_000, F.explode(extract.climb("url")))
        links = links.union(up)
    if o.known_files:
        extra = base.where(F.col("source").rlike(r"/(?:robots\.txt|sitemap\.xml)$"))
        robots = extra.select("source", F.lit(0), F.explode(F.transform(extract.robots_links("body"), lambda x: x["target"])).alias("raw")).select("source", F.lit(0), U.join("source", "raw"))
        maps = extra.select("source", F.lit(0), F.explode(extract.sitemap_links("body")).alias("raw")).select("source", F.lit(0), U.join("source", "raw"))
        links = links.union(robots).union(maps).where("url <> ''")
        seeds = seeds.union(seeds.select(F.explode(extract.known_files("url"))))
    links = saved(cycles.without_cycles(saved(links)))
    roots = seeds.select(U.host("url").alias("h")).distinct()
    test = filters.extension_allowed(U.path("url"), o.extension_match, o.extension_filter) & filters.url_in_scope("url", o.in_scope, o.out_scope)
    if not o.no_scope and o.scope in ("rdn", "fqdn", "dn"):
        # The seeds are the caller's list, so their hosts are few: the scope is a literal list.
        hosts = [r.h for r in roots.collect()]
        if len(hosts) > 10_000:
            raise OptionError("over 10000 seed hosts")
        test = test & U.any_of([filters.in_scope(U.host("url"), F.lit(h), o.scope) for h in hosts])
    if o.auth_credentials:
        test = test & ~U.is_logout("url")
    content = base.select(F.col("source").alias("url"), dedup.content_key("body").alias("content")).where("body <> ''") if o.content_dedup else None
    if o.strategy == "depth-first":
        walked = frontier.depth_first(seeds, where_once(links, test), o.max_depth, content)
        # a page that several seeds reach counts for the least of them
        first = walked.groupBy("url").agg(F.min_by(F.struct("depth", "parent", "place"), F.struct("seed", "place")).alias("r"))
        visited = saved(first.select("url", "r.*"))
    else:
        visited = frontier.crawl(seeds, links, o.max_depth, test, content).visited
    out = visited.join(base.withColumnRenamed("source", "url"), "url").where("body <> ''" if "status_code" not in given else "body <> '' or status_code >= 400")
    if o.max_domain_pages:
        out = filters.host_cap(out.withColumn("_host", U.host("url")), "_host", ["depth", "url"], o.max_domain_pages).drop("_host")
    out = out.where(filters.output_filter("url", o.match_regex, o.filter_regex))
    if o.match_condition:
        out = out.where(dsl.compile_filter(o.match_condition, out.schema))
    if o.filter_condition:
        out = out.where(~dsl.compile_condition(o.filter_condition, out.schema))
    if o.filter_page_type:
        kind = filters.page_type("status_code" if "status_code" in given else F.lit(200), "body", o.filter_page_type)
        out = where_once(out, kind.isNull())
    if o.tech_detect:
        out = out.withColumn("technologies", analyze.technologies("headers" if "headers" in given else F.create_map().cast("map<string,string>"), "body"))
    if o.knowledge_base:
        out = out.withColumn("knowledge_base", analyze.knowledge_base("body"))
    if o.form_extraction:
        forms = pages.page_facts(out.select("url", "body"), ["url"], parts=("forms",))
        out = out.join(forms, "url")
    if o.fields:
        out = out.withColumn("fields", output.field_values("url", o.fields))
    if o.display_out_scope:
        # links of visited pages that the scope keeps out, each once, with the first page that has it
        away = where_once(links.join(visited.select(F.col("url").alias("source"), "depth"), "source"), ~test)
        away = away.groupBy("url").agg(F.min_by(F.struct(F.col("depth") + 1, "source"), F.struct("depth", "source", "ord")).alias("r"))
        away = away.select("url", F.col("r.col1").alias("depth"), F.col("r.source").alias("parent"), F.lit("url out of scope").alias("error"))
        out = out.withColumn("error", F.lit(None).cast("string")).unionByName(away, allowMissingColumns=True)
    if o.store_response:
        from .sources.sinks import response_store

        out = saved(out)
        stored = out.where("error is null") if o.display_out_scope else out
        response_store(stored, o.store_response_dir or "harvestry_response")
    return out


def process(corpus: DataFrame, on_page: Callable | None = None) -> DataFrame:
    """(url, title, markdown_ir) of the corpus; on_page(url, title, markdown) is called in the executors, its errors logged and passed over."""
    out = pages.page_facts(corpus, ["url"], parts=("title", "markdown_ir"))
    if on_page is None:
        return out

    def call(batches):
        import logging

        for b in batches:
            for r in b.itertuples(index=False):
                try:
                    on_page(r.url, r.title, r.markdown_ir)
                except Exception:  # noqa: BLE001 - a callback must not stop the pipeline
                    logging.getLogger(__name__).exception("on_page")
            yield b

    return out.mapInPandas(call, out.schema)


def health(spark: SparkSession) -> dict:
    return {"version": __version__, "spark": spark.version, "master": spark.sparkContext.master}


class Browser:
    """Fluent set-up of the page pipeline over a corpus: only what concerns data, no rendering."""

    def __init__(self):
        self._start: list[str] = []
        self._depth, self._pages, self._exporter, self._on_page, self._folder = 2, 0, None, None, None

    @classmethod
    def builder(cls) -> Browser:
        return cls()

    def start_url(self, url: str) -> Browser:
        self._start.append(url)
        return self

    def max_depth(self, depth: int) -> Browser:
        self._depth = depth
        return self

    def max_pages(self, pages_: int) -> Browser:
        self._pages = pages_
        return self

    def output_dir(self, path: str) -> Browser:
        self._folder = path
        return self

    def exporter(self, write: Callable[[DataFrame], None]) -> Browser:
        """write(pages): called with (url, title, markdown_ir)."""
        self._exporter = write
        return self

    def on_page(self, call: Callable[[str, str, str], None]) -> Browser:
        self._on_page = call
        return self

    def build(self) -> Browser:
        if not self._start:
            raise OptionError("a start address is required")
        if self._depth <= 0:
            raise OptionError("a depth is required")
        return self

    def run(self, spark: SparkSession, corpus: DataFrame) -> DataFrame:
        """Summary (pages_processed, total_ir_bytes) of the pages reached; exports on the way."""
        reached = crawl(spark, corpus, Options(urls=self._start, max_depth=self._depth))
        if self._pages:
            from pyspark.sql.window import Window

            # first pages of the whole crawl: a level holds its own first ones, then the levels are put together
            per = F.row_number().over(Window.partitionBy("depth").orderBy("url"))
            reached = reached.withColumn("_n", per).where(F.col("_n") <= self._pages).orderBy("depth", "url").limit(self._pages).drop("_n")
        done = saved(process(reached, self._on_page))
        if self._exporter:
            self._exporter(done)
        if self._folder:
            from .operators import output

            done.select(U.export_filename("url").alias("file"), output.markdown_page("title", "markdown_ir").alias("value")).write.mode("overwrite").partitionBy("file").text(self._folder)
        return frontier.ir_summary(done)


def site_map(spark: SparkSession, corpus: DataFrame, urls: list[str], max_depth: int = 2, max_pages: int = 0) -> DataFrame:
    """(seed, url, parent_url, depth, dfs_order) over the same-host links of a corpus (url, body); max_pages a seed, 0 for all."""
    base = corpus.select(U.normalize("url", keep_fragment=False).alias("source"), "body").where("source is not null").groupBy("source").agg(F.min("body").alias("body"))
    facts = pages.page_facts(base, ["source"], parts=("links",))
    links = pages.page_links(facts, ["source"], "source")
    seeds = spark.createDataFrame([(u,) for u in urls], "url string").select(U.normalize(U.with_scheme("url"), keep_fragment=False).alias("url"))
    return frontier.site_tree(seeds, links, max_depth, max_pages, base.select(F.col("source").alias("url")))
