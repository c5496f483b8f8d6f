"""Traversal: a crawl over a stored corpus as a fixpoint of joins, summaries, and the depth-first site map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import saved
from . import pacing


@dataclass
class Crawl:
    """visited (url, depth, parent) and levels, the number of rounds it took."""

    visited: DataFrame
    levels: int


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int = 3, allowed: Column | None = None, content: DataFrame | None = None) -> Crawl:
    """Breadth first from seeds (url) over links (source, ord, url).

    A level is one join of the frontier with the links and one anti join with what was visited; each level is written to
    the checkpoint folder, so that a lost executor costs a level, not the crawl.  A page belongs to the first link to it:
    least depth, then parent, then place on the page.  Uniqueness is consumed before `allowed` is asked.  With content
    (url, content), a page whose content was met before is passed over, and so are its links.
    """
    met = None

    def fresh(new: DataFrame) -> DataFrame:
        """Pages of a level whose content is new: the first address of each, none of content met on levels before."""
        nonlocal met
        with_key = new.join(content, "url", "left")
        keyed = with_key.where("content is not null")
        first = keyed.groupBy("content").agg(F.min("url").alias("url"))
        if met is not None:
            first = first.join(met, "content", "left_anti")
        first = saved(first)
        met = first.select("content") if met is None else met.union(first.select("content"))
        return saved(with_key.where("content is null").drop("content").union(keyed.join(first.select("url"), "url", "left_semi").drop("content")))

    level = saved(seeds.select("url").where("url is not null").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    if content is not None:
        level = fresh(level)
    visited, known, n = level, level.select("url"), 0
    edges = links.select(F.col("source").alias("parent"), "ord", F.col("url").alias("to")).where("`to` is not null and `to` <> ''")
    while not max_depth or n < max_depth:
        n += 1
        found = level.select(F.col("url").alias("parent")).join(edges, "parent")
        one = found.groupBy("to").agg(F.min(F.struct("parent", "ord")).alias("m")).select(F.col("to").alias("url"), F.lit(n).alias("depth"), F.col("m.parent").alias("parent"))
        new = saved(one.join(known, "url", "left_anti"))
        if new.isEmpty():
            break
        known = known.union(new.select("url"))
        level = new.where(allowed) if allowed is not None else new
        if content is not None:
            level = fresh(level)
        visited = visited.union(level)
    return Crawl(visited, n)


def summary(rows: DataFrame, disposition: str = "disposition") -> DataFrame:
    """(disposition, rows) counts."""
    return rows.groupBy(disposition).agg(F.count("*").alias("rows"))


def ir_summary(pages: DataFrame, markdown: str = "markdown_ir") -> DataFrame:
    """(pages_processed, total_ir_bytes), one row."""
    return pages.agg(F.count("*").alias("pages_processed"), F.coalesce(F.sum(F.octet_length(markdown)), F.lit(0)).alias("total_ir_bytes"))


def progress(rows: DataFrame, order: list[str], counted: dict[str, Column], by: list[str]) -> DataFrame:
    """rows with running counts by group, order[0] being a number or a time."""
    return pacing.running_counts(rows, order[0], order[1:], counted, by)


def site_tree(seeds: DataFrame, links: DataFrame, max_depth: int = 2, max_pages: int = 0, fetched: DataFrame | None = None) -> DataFrame:
    """(seed, url, parent_url, depth, dfs_order): depth-first site maps, one a seed.

    Depth first is sequential in one seed's pages, and a deep path can claim a page before a short one does; so each
    seed's part of the graph (the pages within max_depth of it) goes to one task, and seeds run side by side.  max_pages
    bounds the attempts of a seed, pages that could not be fetched among them; 0 is no limit.
    """
    reach = saved(seeds.select(F.col("url").alias("seed"), "url").distinct())
    edges = links.select(F.col("source"), "ord", F.col("url").alias("target")).where("target is not null and target <> ''")
    level, seen = reach, reach
    for _ in range(max_depth):
        level = saved(level.join(edges, level.url == edges.source).select("seed", F.col("target").alias("url")).distinct().join(seen, ["seed", "url"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.union(level)
    part = seen.join(edges, seen.url == edges.source).select("seed", "source", "ord", "target")
    # every page once more without a link, so that one without links is known too
    part = part.union(seen.select("seed", F.col("url").alias("source"), F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("target")))
    have = fetched.select(F.col("url").alias("source"), F.lit(True).alias("ok")) if fetched is not None else None
    if have is not None:
        part = part.join(have, "source", "left").select("seed", "source", "ord", "target", F.coalesce("ok", F.lit(False)).alias("ok"))
    else:
        part = part.withColumn("ok", F.lit(True))

    anything = fetched is None

    def tree(pdf):
        import pandas as pd

        kids: dict[str, list[str]] = {}
        ok: dict[str, bool] = {}
        for r in pdf.sort_values("ord").itertuples():
            ok[r.source] = ok.get(r.source, False) or bool(r.ok)
            if r.target is not None:
                kids.setdefault(r.source, []).append(r.target)
        seed = pdf["seed"].iloc[0]
        rows, visited, attempts = [], set(), 0
        todo = [(seed, None, 0)]
        while todo:
            url, parent, depth = todo.pop()
            if url in visited or 0 < max_pages <= attempts:
                continue
            visited.add(url)
            attempts += 1
            if not ok.get(url, anything):
                continue
            rows.append((seed, url, parent, depth, len(rows)))
            if depth < max_depth:
                todo += [(k, url, depth + 1) for k in reversed(kids.get(url, []))]
        return pd.DataFrame(rows, columns=["seed", "url", "parent_url", "depth", "dfs_order"])

    return part.groupBy("seed").applyInPandas(tree, "seed string, url string, parent_url string, depth int, dfs_order int")


def depth_first(seeds: DataFrame, links: DataFrame, max_depth: int = 3, content: DataFrame | None = None) -> DataFrame:
    """(seed, url, depth, parent, place): the order in which a last-in-first-out queue gives pages out, one queue a seed.

    A page is queued once, by the first page that links to it; the last link of a page comes out first.  With content (url,
    content), a page whose content was met before is passed over, and so are its links.  The order is sequential in one
    seed's pages, so each seed's part of the graph (the pages within max_depth of it) goes to one task; seeds run side by side.
    """
    reach = saved(seeds.select(F.col("url").alias("seed"), "url").where("url is not null").distinct())
    edges = links.select("source", "ord", F.col("url").alias("target")).where("target is not null and target <> ''")
    level, seen, n = reach, reach, 0
    while not max_depth or n < max_depth:
        n += 1
        level = saved(level.join(edges, level.url == edges.source).select("seed", F.col("target").alias("url")).distinct().join(seen, ["seed", "url"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.union(level)
    part = seen.join(edges, seen.url == edges.source).select("seed", "source", "ord", "target")
    part = part.union(seen.select("seed", F.col("url").alias("source"), F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("target")))
    keys = content.select(F.col("url").alias("source"), F.col("content").cast("string").alias("content")) if content is not None else None
    part = part.join(keys, "source", "left").select("seed", "source", "ord", "target", "content") if keys is not None else part.withColumn("content", F.lit(None).cast("string"))

    def walk(pdf):
        import pandas as pd

        seed = pdf["seed"].iloc[0]
        kids: dict[str, list[str]] = {}
        key: dict[str, str] = {}
        for r in pdf.sort_values("ord", kind="stable").itertuples():
            if isinstance(r.target, str):
                kids.setdefault(r.source, []).append(r.target)
            if isinstance(r.content, str):
                key[r.source] = r.content
        rows, met, queued, todo = [], set(), {seed}, [(seed, None, 0)]
        while todo:
            url, parent, depth = todo.pop()
            if url in key:
                if key[url] in met:
                    continue
                met.add(key[url])
            rows.append((seed, url, depth, parent, len(rows)))
            if not max_depth or depth < max_depth:
                for k in kids.get(url, []):
                    if k not in queued:
                        queued.add(k)
                        todo.append((k, url, depth + 1))
        return pd.DataFrame(rows, columns=["seed", "url", "depth", "parent", "place"])

    return part.groupBy("seed").applyInPandas(walk, "seed string, url string, depth int, parent string, place int")
