"""Sinks: text files, per-host stores, Markdown files, nested site maps."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).where("value is not null and value <> ''").write.mode("overwrite").text(path)


def response_store(df: DataFrame, path: str) -> None:
    """The raw store: path/responses has (file, content), content being address, raw request and raw response; path/index has a line
    "file url (status)" for each.

    Files of a host stay together as rows of Parquet, in order of their names, instead of a file a page.  df: (url, body) and,
    where there are any, method, status_code, headers.
    """
    from ..operators import output

    of = lambda c, other: F.col(c) if c in df.columns else other
    status, headers = of("status_code", F.lit(200)), "headers" if "headers" in df.columns else None
    content = F.concat_ws("\n\n", F.col("url"), output.raw_request(of("method", F.lit("GET")), "url", F.lit("")), output.raw_response(status, headers, "body"))
    rows = df.select(output.store_path("url").alias("file"), "url", status.alias("status"), content.alias("content"))
    rows.select("file", "content").repartitionByRange("file").sortWithinPartitions("file").write.mode("overwrite").parquet(f"{path}/responses")
    write_lines(rows, F.concat(F.col("file"), F.lit(" "), F.col("url"), F.lit(" ("), F.coalesce(F.col("status").cast("string"), F.lit("")), F.lit(")")), f"{path}/index")


def nested_tree(rows: list[dict]) -> str:
    """JSON of a depth-first site map: an object for one root, an array for more."""
    nodes, roots = {}, []
    for r in sorted(rows, key=lambda r: (r["seed"], r["dfs_order"])):
        n = {"url": r["url"], "depth": r["depth"], "children": []}
        nodes[r["seed"], r["url"]] = n
        up = nodes.get((r["seed"], r["parent_url"])) if r["parent_url"] else None
        (up["children"] if up else roots).append(n)
    return json.dumps(roots[0] if len(roots) == 1 else roots, indent=2)


def fresh_folder(path: str, limit: int = 1000) -> str:
    """path, or path-1, path-2 ... where it exists."""
    p = Path(path)
    for i in range(limit):
        q = p if i == 0 else p.with_name(f"{p.stem}-{i}{p.suffix}")
        if not q.exists():
            return str(q)
    raise FileExistsError(path)
