"""Page facts: one Arrow pass that parses a page once, then columns and explodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import html as H
from ..functions import urls as U
from ..plans.lineage import where_once

PARTS = {
    "title": "string",
    "markdown_ir": "string",
    "links": "array<struct<tag:string,attribute:string,method:string,raw:string>>",
    "forms": "array<struct<method:string,action:string,enctype:string,parameters:array<string>>>",
    "filled": "array<struct<method:string,action:string,body:string,enctype:string>>",
}


def _facts(body: str | None, parts: tuple[str, ...], scripts: bool, jsluice: bool) -> dict:
    root = H.parse(body or "")
    out = {}
    if "title" in parts:
        out["title"] = H.title(root)
    if "markdown_ir" in parts:
        out["markdown_ir"] = H.markdown(root)
    if "links" in parts:
        found = H.links(root, scripts, jsluice)
        if body and (system := H.doctype_system(body)):
            found.append(("html", "doctype", "GET", system))
        out["links"] = [dict(zip(("tag", "attribute", "method", "raw"), x)) for x in found if H.valid(x[3])]
    if "forms" in parts:
        out["forms"] = [dict(zip(("method", "action", "enctype", "parameters"), x)) for x in H.forms(root)]
    if "filled" in parts:
        out["filled"] = [dict(zip(("method", "action", "body", "enctype"), x)) for x in H.filled_requests(root)]
    return out


def page_facts(df: DataFrame, keep: list[str], body: str = "body", parts: tuple[str, ...] = ("title", "markdown_ir", "links", "forms"), scripts: bool = False, jsluice: bool = False) -> DataFrame:
    """keep columns and the parts asked for, one row a page; nothing but them goes through Python."""
    from pyspark.sql.pandas.types import to_arrow_schema

    src = df.select(*keep, F.col(body).alias("_body"))
    schema = src.select(*keep).schema
    for p in parts:
        schema = schema.add(StructType.fromDDL(f"{p} {PARTS[p]}")[0])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            facts = [_facts(x, parts, scripts, jsluice) for x in b.column(len(keep)).to_pylist()]
            cols = [b.column(i).cast(out.field(i).type) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([f[p] for f in facts], out.field(p).type) for p in parts], schema=out)

    return src.mapInArrow(run, schema)


def link_rows(facts: DataFrame, keys: list[str], base: str | Column) -> DataFrame:
    """(keys, ord, tag, attribute, method, url): links resolved against the page's address, without fragments."""
    out = facts.select(*keys, U.col(base).alias("_base"), F.posexplode("links").alias("ord", "l")).select(*keys, "_base", "ord", "l.tag", "l.attribute", "l.method", "l.raw")
    return U.joined(out, "url", "_base", "raw").select(*keys, "ord", "tag", "attribute", "method", "url")


def page_links(facts: DataFrame, keys: list[str], base: str | Column, same_host: bool = True, keep_fragment: bool = False, drop_base: bool = True) -> DataFrame:
    """(keys, ord, url): a[href] links of http(s), each once a page; on the same host and not the page itself where asked."""
    b = U.col(base)
    hrefs = facts.select(*keys, b.alias("_base"), F.posexplode(F.filter("links", lambda l: (l["tag"] == "a") & (l["attribute"] == "href"))).alias("ord", "l"))
    raw = F.trim(F.col("l.raw"))
    rows = hrefs.where(~raw.startswith("#") & ~raw.startswith("javascript:") & ~raw.startswith("mailto:"))
    rows = U.joined(rows, "url", "_base", raw, keep_fragment=keep_fragment)
    keep = U.scheme("url").isin("http", "https")
    if same_host:
        keep = keep & (U.host("url") == U.host("_base"))
    if drop_base:
        rows = rows.withColumn("_self", U.normalize("_base", keep_fragment=False))
        keep = keep & (F.col("url") != F.col("_self"))
    rows = where_once(rows, keep)
    return rows.groupBy(*keys, "url").agg(F.min("ord").alias("ord")).select(*keys, "ord", "url")
