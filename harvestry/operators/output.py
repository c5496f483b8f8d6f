"""Projections and lines of output: the 14 address fields, templates, JSON lines, screen lines, stores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from .analyze import BUILTIN


def single_fields(u: str | Column) -> dict[str, Column]:
    """The fields of an address that have one value, null where they have none."""
    u = U.col(u)
    q, p, r = U.query(u), U.path(u), U.root(u)
    file, folder, pairs = U.file_base(p), U.directory(p), q.rlike("[^&]")
    return {
        "url": u,
        "path": p,
        "fqdn": U.host(u),
        "rdn": U.registrable_domain(U.host(u)),
        "rurl": r,
        "qurl": F.when(pairs, u),
        "qpath": F.when(pairs, U.sorted_query_path(u)),
        "file": F.nullif(file, F.lit("")),
        "ufile": F.when(file != "", u),
        "dir": F.nullif(folder, F.lit("")),
        "udir": F.when(folder != "", F.concat(r, folder)),
    }


def many_fields(u: str | Column) -> dict[str, Column]:
    """The fields of an address that have a value for each pair of its query."""
    pairs = U.query_pairs(U.query(u))
    return {"key": F.transform(pairs, lambda x: x["k"]), "value": F.transform(pairs, lambda x: x["v"]), "kv": F.transform(pairs, lambda x: F.concat(x["k"], F.lit("="), x["v"]))}


def field_values(u: str | Column, names: list[str] | None = None) -> Column:
    """array<struct<field,value>> of the named fields (all by default) in their order; a field without value has no entry."""

    # One function a name: a lambda with two arguments would be given the index.
    def named(n: str):
        return lambda x: F.struct(F.lit(n).alias("field"), x.alias("value"))

    one, many = single_fields(u), many_fields(u)
    entries = []
    for n in BUILTIN:
        if names is None or n in names:
            entries.append(F.transform(many[n], named(n)) if n in many else F.filter(F.array(F.struct(F.lit(n).alias("field"), one[n].alias("value"))), lambda x: x["value"].isNotNull()))
    return F.when((U.scheme(u) != "") & (U.host(u) != ""), F.concat(*entries))


def check_field_names(names: list[str], custom: list[str] = ()) -> list[str]:
    for n in names:
        if n not in BUILTIN and n not in custom:
            raise ValueError(f"unknown field {n}")
    return names


def present(schema: T.StructType, exclude: tuple[str, ...] = (), prefix: str = "") -> Column:
    """The row as a struct in which empty strings, lists, maps and zeros are null, keys in order, dotted names left out."""
    cells = []
    for f in sorted(schema.fields, key=lambda f: f.name):
        name = f"{prefix}{f.name}"
        if name in exclude:
            continue
        c = F.col(".".join(f"`{p}`" for p in name.split(".")))
        if isinstance(f.dataType, T.StructType):
            c = F.when(c.isNotNull(), present(f.dataType, exclude, name + "."))
        elif isinstance(f.dataType, T.StringType):
            c = F.when(c != "", c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            c = F.when(F.size(c) > 0, c)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, c)
        elif isinstance(f.dataType, T.NumericType):
            c = F.when(c != 0, c)
        cells.append(c.alias(f.name))
    return F.struct(*cells) if cells else F.lit(None)


def json_line(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    return F.to_json(present(df.schema, exclude))


def screen_line(url: str | Column, method: str | Column, body: str | Column, tag: str | Column, depth: str | Column, verbose: bool = False) -> Column:
    if not verbose:
        return U.text(url)
    part = lambda c: F.when(U.text(c) != "", F.concat(F.lit("["), U.text(c), F.lit("]")))
    return F.concat_ws(" ", part(tag), part(method), U.text(url), part(body), F.concat(F.lit("[depth:"), U.col(depth).cast("string"), F.lit("]")))


def field_lines(u: str | Column, names: list[str], verbose: bool = False) -> Column:
    """One value a line for the named fields."""
    kept = field_values(u, check_field_names(names))
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("["), x["field"], F.lit("] "), x["value"]) if verbose else x["value"]), "\n")


def template(text: str, u: str | Column, document: Column | None = None, custom: Column | None = None) -> Column:
    """{{field}} of the address (the last of several values), {{name}} of custom fields joined by commas, {{.a.b}} from the JSON document.

    A name without value makes the row null; a path without value is empty.
    """
    cells: list[Column] = []
    one, many, at, of_address = single_fields(u), many_fields(u), 0, False
    for m in re.finditer(r"\{\{\s*(\.?)([A-Za-z0-9_.-]+)\s*\}\}", text):
        cells.append(F.lit(text[at : m.start()]))
        at = m.end()
        dot, name = m.groups()
        if dot:
            cells.append(F.coalesce(F.get_json_object(document, "$." + name), F.lit("")) if document is not None else F.lit(""))
        elif name in BUILTIN:
            of_address = True
            cells.append(one[name] if name in one else F.try_element_at(many[name], F.lit(-1)))
        else:
            found = F.try_element_at(custom, F.lit(name)) if custom is not None else F.lit(None).cast("array<string>")
            cells.append(F.array_join(found, ","))
    cells.append(F.lit(text[at:]))
    whole = F.concat(*cells)
    return F.when((U.scheme(u) != "") & (U.host(u) != ""), whole) if of_address else whole


def raw_request(method: str | Column, u: str | Column, body: str | Column, headers: str | Column | None = None) -> Column:
    u = U.col(u)
    q = U.query(u)
    target = F.concat(U.path(u), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(U.text(method), F.lit(" "), target, F.lit(" HTTP/1.1\r\nHost: "), U.host(u), F.lit("\r\n"), header_block(headers), F.lit("\r\n"), U.text(body))


def header_block(headers: str | Column | None) -> Column:
    """Header lines in order of their names."""
    if headers is None:
        return F.lit("")
    each = F.transform(F.array_sort(F.map_entries(U.col(headers))), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n")))
    return F.coalesce(F.array_join(each, ""), F.lit(""))


def raw_response(status: str | Column, headers: str | Column | None, body: str | Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 "), U.col(status).cast("string"), F.lit("\r\n"), header_block(headers), F.lit("\r\n"), U.text(body))


def store_path(u: str | Column) -> Column:
    """host[_port]/md5(url).txt"""
    return F.concat(U.response_host(u), F.lit("/"), U.response_hash(u), F.lit(".txt"))


def field_store_path(u: str | Column, name: str | Column) -> Column:
    return F.concat(U.scheme(u), F.lit("_"), U.response_host(u), F.lit("_"), U.col(name), F.lit(".txt"))


def markdown_page(title: str | Column, markdown: str | Column) -> Column:
    return F.concat(F.lit("# "), U.col(title), F.lit("\n\n"), U.col(markdown), F.lit("\n"))


def plain(c: str | Column) -> Column:
    """Text without terminal colour codes."""
    return F.regexp_replace(U.text(c), "\x1b(\\[[^A-Za-z]*[A-Za-z])?", "")


def first_output(*formats: Column) -> Column:
    """Template, JSON, Markdown, fields, screen: the first that is asked for and not empty; null drops the row."""
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in formats])


def event_error(ts: str | Column, endpoint: str | Column, source: str | Column, error: str | Column) -> Column:
    return F.to_json(F.struct(U.rfc3339(ts).alias("timestamp"), U.col(endpoint).alias("endpoint"), U.col(source).alias("source"), U.col(error).alias("error")))
