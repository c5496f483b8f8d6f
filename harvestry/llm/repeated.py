"""Problem 3: lines repeated across one site's documents.

Method: each line's documents are stored as compressed bitmaps per site: ids are
split into containers of 65 536, and a container is an array, a run list or a
plain bitmap, whichever is smallest.  Spelling variants of a line (case, blanks)
are united, cardinalities are exact, the threshold is put on them, and lines are
deleted from a page by looking the page up in the line's bitmap.

Skew: a hot site's or a hot line's documents are united per batch in the mapper
and are partitioned by (line, container), so that no task holds more than 65 536
documents of one line; texts of lines never enter the shuffle, only 64-bit keys.

Defined cases: rows without url, host or page_id belong to no site; null or empty
texts have no lines but count as pages of the site; a page counts once however
often its row or the line is repeated.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_arrow, maybe_among, saved, site_of

ARRAY, RUNS, BITS = 0, 1, 2
_blanks = re.compile(r"[ \t]+")
_sign = re.compile(r"[^\W_]")


def encode(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit values as the smallest kind of container."""
    low = low.astype("<u2")
    n = len(low)
    if n < 4:
        return bytes([ARRAY]) + low.tobytes()
    breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1)
    runs = len(breaks) + 1
    kinds = ((2 * n, ARRAY), (4 * runs, RUNS), (8192, BITS))
    kind = min(kinds)[1]
    if kind == ARRAY:
        return bytes([ARRAY]) + low.tobytes()
    if kind == RUNS:
        first = low[np.r_[0, breaks + 1]]
        last = low[np.r_[breaks, n - 1]]
        return bytes([RUNS]) + np.stack([first, last], 1).astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return bytes([BITS]) + np.packbits(bits).tobytes()


def decode(b: bytes) -> np.ndarray:
    """The sorted values of a container."""
    kind, body = b[0], b[1:]
    if kind == ARRAY:
        return np.frombuffer(body, "<u2")
    if kind == RUNS:
        r = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64)
        return np.concatenate([np.arange(a, z + 1) for a, z in r]).astype(np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8))).astype(np.uint16)


def union(parts: list[bytes]) -> bytes:
    return parts[0] if len(parts) == 1 else encode(np.unique(np.concatenate([decode(p) for p in parts])))


def normal(line: str) -> str | None:
    """The line as it is compared, or null if it has no letter or digit."""
    s = line
    if "\t" in s or "  " in s:
        s = _blanks.sub(" ", s)
    s = s.strip().lower()
    return s if s and (s[0].isalnum() or _sign.search(s)) else None


def key_of(site: str, line: str) -> int:
    return xxhash.xxh64_intdigest(f"{site}\n{line}") - (1 << 63)


def _lines(text: str | None) -> set[str]:
    return {n for n in map(normal, text.split("\n")) if n} if text else set()


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, page_id, text) -> (site key, line key, container, bitmap), united within the batch; line key 0 counts the site's pages."""
    for b in batches:
        sites, ids, texts = (c.to_pylist() for c in b.columns)
        found: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for s, i, t in zip(sites, ids, texts):
            sk, low = key_of(s, ""), i & 0xFFFF
            found[sk, 0, i >> 16].append(low)
            for n in _lines(t):
                found[sk, key_of(s, n), i >> 16].append(low)
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array([k[2] for k in keys], pa.int64()),
                pa.array([encode(np.unique(np.array(v, np.uint16))) if len(v) > 1 else b"\0" + v[0].to_bytes(2, "little") for v in found.values()], pa.binary()),
            ],
            names=["sk", "lk", "container", "bitmap"],
        )


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sk, lk, container): one row for each, with the united bitmap, its cardinality and its first document."""
    now, parts = None, []
    names = ["sk", "lk", "container", "bitmap", "n", "first"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def row(k, parts):
        if len(parts) == 1 and len(parts[0]) == 3:
            return (*k, parts[0], 1, (k[2] << 16) + int.from_bytes(parts[0][1:], "little"))
        u = union(parts)
        d = decode(u)
        return (*k, u, len(d), (k[2] << 16) + int(d[0]))

    for b in batches:
        out = []
        for *k, m in zip(*(c.to_pylist() for c in b.columns)):
            if k != now:
                if parts:
                    out.append(row(now, parts))
                now, parts = k, [m]
            else:
                parts.append(m)
                if len(parts) > 64:  # keeps a hot line's parts few
                    parts = [union(parts)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[row(now, parts)]), kinds)], names=names)


def line_bitmaps(pages: DataFrame) -> DataFrame:
    """(sk, lk, container, bitmap, n, first): the documents of every line of every site; lk 0 has all documents of the site."""
    src = pages.select(site_of("url").alias("site"), F.col("page_id").cast("long").alias("page_id"), "markdown_ir").where("site is not null and page_id is not null")
    part = src.mapInArrow(_partial, "sk long, lk long, container long, bitmap binary")
    return part.repartition("lk", "sk", "container").sortWithinPartitions("sk", "lk", "container").mapInArrow(_unite, "sk long, lk long, container long, bitmap binary, n long, first long")


def repeated_keys(bitmaps: DataFrame, least: int = 5, share: float = 0.1) -> DataFrame:
    """(sk, lk, n, first) of the lines on at least `least` documents and `share` of the site's documents, by their bitmaps."""
    counts = bitmaps.groupBy("sk", "lk").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    # Written once and used twice: the site's size comes from its own row (lk 0), not from a second pass.
    kept = saved(counts.where((F.col("n") >= least) | (F.col("lk") == 0)))
    sizes = kept.where("lk = 0").select("sk", F.col("n").alias("size"))
    return kept.where("lk <> 0").join(sizes, "sk").where(F.col("n") >= F.ceil(F.col("size") * F.lit(share) - F.lit(1e-9))).select("sk", "lk", "n", "first")


def repeated_lines(pages: DataFrame, least: int = 5, share: float = 0.1) -> DataFrame:
    """(site, line, documents).  The text of a line is read again from one of its documents."""
    keys = repeated_keys(line_bitmaps(pages), least, share)
    wanted = keys.groupBy("first").agg(F.collect_set("lk").alias("lks"))  # at most the lines of one page each
    src = pages.select(site_of("url").alias("site"), F.col("page_id").cast("long").alias("page_id"), "markdown_ir")
    src = maybe_among(src, "page_id", wanted.select(F.col("first").alias("id")))
    hits = src.join(wanted, src["page_id"] == wanted["first"]).where("site is not null").select("site", "markdown_ir", "lks")

    def rows(sites, texts, lks):
        for s, t, want in zip(sites, texts, lks):
            want = set(want)
            for n in _lines(t):
                if (k := key_of(s, n)) in want:
                    yield s, n, k

    texts = map_arrow(hits, rows, "site string, line string, k long").distinct()
    return texts.join(keys.select(F.col("lk").alias("k"), F.col("n").alias("documents")), "k").select("site", "line", "documents")


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sk, container, lk): the bitmaps of a site's repeated lines on 65 536 documents, then these documents (lk null)
    by page_id and text.  A document's line goes if its bitmap has the document."""
    names, kinds = ["page_id", "cleaned", "deleted"], [pa.int64(), pa.string(), pa.int32()]
    at, maps, last = None, {}, None
    for b in batches:
        out = []
        for sk, container, lk, bitmap, page, site, text in zip(*(c.to_pylist() for c in b.columns)):
            if (sk, container) != at:
                at, maps = (sk, container), {}
            if lk is not None:
                maps[lk] = decode(bitmap)
                continue
            if (sk, page, text) == last:
                continue  # the row repeated
            last = (sk, page, text)
            kept, gone, low = [], 0, page & 0xFFFF
            for x in (text or "").split("\n"):
                n = normal(x) if maps else None
                m = maps.get(key_of(site, n)) if n else None
                if m is not None and (k := int(np.searchsorted(m, low))) < len(m) and m[k] == low:
                    gone += 1
                else:
                    kept.append(x)
            out.append((page, "\n".join(kept), gone))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def without_repeated(pages: DataFrame, least: int = 5, share: float = 0.1) -> DataFrame:
    """(page_id, cleaned, deleted): every page's text without its site's repeated lines, deleted by bitmap lookup.

    The bitmaps are built once and written; those of the repeated lines meet the documents of their container (65 536 ids of
    a site), where each line of a page is looked up.  A site has at most 1 / share times as many repeated lines as its pages
    have on average, so that what a task holds of them does not grow with the data.  Pages of no site keep their text.
    """
    bitmaps = saved(line_bitmaps(pages))
    keys = repeated_keys(bitmaps, least, share)
    none = lambda t: F.lit(None).cast(t)
    maps = bitmaps.join(keys.select("sk", "lk"), ["sk", "lk"], "left_semi").select("sk", "container", "lk", "bitmap", none("long").alias("page_id"), none("string").alias("site"), none("string").alias("text"))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), site_of("url").alias("site"), F.col("markdown_ir").alias("text")).where("page_id is not null")

    def keyed(ids, sites, texts):
        return ((key_of(s, "") if s else None, i >> 16, i, s, t) for i, s, t in zip(ids, sites, texts))

    docs = map_arrow(src, keyed, "sk long, container long, page_id long, site string, text string").select("sk", "container", none("long").alias("lk"), none("binary").alias("bitmap"), "page_id", "site", "text")
    both = maps.union(docs).repartition("sk", "container").sortWithinPartitions("sk", "container", F.col("lk").asc_nulls_last(), "page_id", "text")
    return both.mapInArrow(_delete, "page_id long, cleaned string, deleted int")
