"""Command line: crawl a stored corpus, list fields, print a site map.

    python -m harvestry.cli crawl --corpus pages.parquet -u https://x.test --depth 3 --json
"""

from __future__ import annotations

import argparse
import sys

from . import __version__, api
from .operators import analyze, output
from .sources import corpus as C


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="harvestry", description="Analytics of crawled pages on Spark")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("fields", help="names of the address fields")
    for name in ("crawl", "map"):
        c = sub.add_parser(name)
        c.add_argument("--corpus", required=True, help="parquet with url and body")
        c.add_argument("-u", "--url", action="append", default=[], help="seed; may be repeated, or a comma list")
        c.add_argument("-d", "--depth", type=int, default=3)
        c.add_argument("--config", help='file of "flag: value" lines')
        c.add_argument("-o", "--output", help="folder for the lines")
        if name == "map":
            c.add_argument("--max-pages", type=int, default=0, help="pages a seed; 0 is no limit")
        if name == "crawl":
            c.add_argument("--scope", default="rdn")
            c.add_argument("--no-scope", action="store_true")
            for flag in ("in-scope", "out-scope", "exclude", "extension-match", "extension-filter", "match-regex", "filter-regex"):
                c.add_argument(f"--{flag}", action="append", default=[])
            c.add_argument("--match-condition", default="")
            c.add_argument("--filter-condition", default="")
            c.add_argument("--known-files", action="store_true")
            c.add_argument("--path-climb", action="store_true")
            c.add_argument("--ignore-query", action="store_true")
            c.add_argument("--max-domain-pages", type=int, default=0)
            c.add_argument("--strategy", default="breadth-first", choices=("breadth-first", "depth-first"))
            for flag in ("scrape-scripts", "scrape-jsluice", "xhr-extraction", "form-extraction", "display-out-scope", "disable-redirects", "knowledge-base", "store-response"):
                c.add_argument(f"--{flag}", action="store_true")
            c.add_argument("--filter-page-type", action="append", default=[])
            c.add_argument("--store-response-dir", default="")
            c.add_argument("--auth-credentials", default="", help="set: logout pages are not visited")
            c.add_argument("--field", action="append", default=[])
            c.add_argument("--template", default="")
            c.add_argument("--json", action="store_true")
            c.add_argument("--tech-detect", action="store_true")
    return p


def options(a: argparse.Namespace) -> api.Options:
    given = {k: v for k, v in vars(a).items() if k in api.Options.__dataclass_fields__}
    if a.config:
        with open(a.config) as f:
            for k, v in C.flags(f.read()).items():
                k = k.replace("-", "_")
                if k in api.Options.__dataclass_fields__:
                    now = getattr(api.Options(), k)
                    given[k] = v.lower() == "true" if isinstance(now, bool) else int(v) if isinstance(now, int) else v.split(",") if isinstance(now, list) else v
    urls = [x.strip() for u in a.url for x in u.split(",") if x.strip()]
    return api.Options(**{**given, "urls": list(dict.fromkeys(urls)), "max_depth": a.depth})


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "fields":
        print("\n".join(analyze.BUILTIN))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("harvestry").getOrCreate()
    pages = C.responses(spark, a.corpus)
    if a.command == "map":
        from .sources.sinks import nested_tree

        tree = api.site_map(spark, pages, [x for u in a.url for x in u.split(",")], a.depth, a.max_pages)
        print(nested_tree([r.asDict() for r in tree.collect()]))  # the map is one text, whole in memory
        return 0
    rows = api.crawl(spark, pages, options(a))
    if a.template:
        line = output.template(a.template, "url")
    elif a.json:
        line = output.json_line(rows, ("body",))
    elif a.field:
        line = output.field_lines("url", output.check_field_names(a.field))
    else:
        line = rows["url"]
    if a.output:
        from .sources.sinks import write_lines

        write_lines(rows, line, a.output)
    else:
        for r in rows.select(line.alias("l")).where("l is not null and l <> ''").toLocalIterator():
            print(r.l)
    return 0


if __name__ == "__main__":
    sys.exit(main())
